"""J5 with more training rows than one task holds: the neighbours are those among all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelab.operators import experiment as ex
from featurelab.operators import learning as ln
from featurelab.operators import neighbours as nb
from featurelab.operators import selectors as sel
from featurelab.plans import catalog_learning as cl

#: More rows in each of two folds than a model in memory has (20,000).
ROWS = 12 * 4200


@pytest.fixture(scope="module")
def twins(spark):
    """Twelve rows of each value, six per fold, with one label: the six nearest are a row's twins."""
    n = F.col("id")
    group = F.floor(n / 12)
    label = (F.pmod(F.xxhash64(group), F.lit(2))).cast("double")
    return spark.range(ROWS).select(n.alias("entity"), (n % 2).cast("int").alias("fold"), group.cast("double").alias("a"),
                                    label.alias("y")).localCheckpoint()


def _brute(train, test, k, p):
    """(keys, labels) of the neighbours of every test row; train holds (key, x, y)."""
    key, x, y = (np.array([t[i] for t in train]) for i in range(3))
    out = []
    for row in test:
        d = np.zeros(len(x))
        for j in range(x.shape[1]):
            d += np.abs(row[j] - x[:, j]) ** p
        at = np.lexsort((y, key, d))[:k]
        out.append((key[at].tolist(), y[at]))
    return out


@pytest.mark.parametrize("dim, p, k, far", [(3, 1, 6, False), (2, 2, 3, False), (20, 1, 6, False), (2, 3, 4, False), (3, 1, 5, True)])
def test_cells_give_the_neighbours_of_all_rows(spark, monkeypatch, dim, p, k, far):
    monkeypatch.setattr(nb, "HELD_ROWS", 50)
    monkeypatch.setattr(nb, "WORTH_A_COPY", 30)
    rng = np.random.default_rng(dim + p)
    x = np.round(rng.normal(size=(700, dim)), 1)
    x[:200] = x[200]                                  # a hot value, in the test rows too
    if far:
        x[5, 0], x[7, 1] = np.inf, -np.inf
    keys = rng.permutation(700)
    train = [(int(i), r.tolist(), float(rng.integers(3))) for i, r in zip(keys, x)]
    train += train[600:650]                           # keys that come twice
    test = [r.tolist() for r in np.round(rng.normal(size=(60, dim)), 1)] + [x[200].tolist()] * 70 + [[1e6] * dim, [None] + [0.0] * (dim - 1)]
    names = [f"f{j}" for j in range(dim)]
    columns = ", ".join(f"{f} double" for f in names)
    m = nb.fit_neighbours(spark.createDataFrame([(i, *r, c) for i, r, c in train], f"entity long, {columns}, y double"), "entity", names, "y", k=k, p=p)
    assert isinstance(m, nb.CellModel) and m.lo.shape[1] > 5 and m.classes == [0.0, 1.0, 2.0]
    got = {r.entity: r for r in m.predict(spark.createDataFrame([(i, *r) for i, r in enumerate(test)], f"entity long, {columns}"), ["entity"]).collect()}
    assert len(got) == len(test)
    last = got[len(test) - 1]
    assert last.prediction is None and last.probability is None and last.neighbours is None
    with np.errstate(all="ignore"):
        want = _brute(train, test[:-1], k, p)
    for i, (near, labels) in enumerate(want):
        votes = [float((labels == c).sum()) / k for c in m.classes]
        assert got[i].neighbours == near and got[i].probability == votes and got[i].prediction == m.classes[int(np.argmax(votes))]


def test_cells_of_text_keys_and_of_one_value(spark, monkeypatch):
    monkeypatch.setattr(nb, "HELD_ROWS", 40)
    rng = np.random.default_rng(9)
    rows = [(f"k{i:04d}" if i else None, float(v), float(i % 2)) for i, v in enumerate(np.round(rng.normal(size=300), 1))]
    df = spark.createDataFrame(rows, "id string, a double, y double")
    got = [r.neighbours for r in nb.fit_neighbours(df, "id", ["a"], "y", k=4).predict(df.select("a"), ["a"]).orderBy("a").collect()]
    place = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or "")))}
    want = _brute([(place[i], [v], y) for i, v, y in rows], [[v] for v in sorted(v for _, v, _ in rows)], 4, 1)
    assert got == [w[0] for w in want]
    # nothing to cut: the first rows by key win, and a part of a cell is not too large for a task
    same = nb.fit_neighbours(spark.range(2000).select("id", F.lit(1.0).alias("a"), (F.col("id") % 2).cast("double").alias("y")), "id", ["a"], "y", k=3)
    assert same.predict(spark.createDataFrame([(5.0,)], "a double"), ["a"]).first().neighbours == [0, 1, 2]
    assert same.rows.groupBy("_cell").count().agg(F.max("count")).first()[0] <= 80


def test_columns_that_borders_do_not_cut(spark, monkeypatch):
    """Cells that the drawn rows left too large are dealt over several."""
    monkeypatch.setattr(nb, "HELD_ROWS", 100)
    monkeypatch.setattr(nb, "DRAWN_NUMBERS", 4)       # too few for any border
    rng = np.random.default_rng(3)
    train = [(i, rng.normal(size=2).tolist(), float(i % 2)) for i in range(900)]
    df = spark.createDataFrame([(i, *x, y) for i, x, y in train], "id long, a double, b double, y double")
    m = nb.fit_neighbours(df, "id", ["a", "b"], "y", k=5)
    assert m.lo.shape[1] == 9 and m.rows.groupBy("_cell").count().agg(F.max("count")).first()[0] <= 200
    got = {r.id: r.neighbours for r in m.predict(df, ["id"]).collect()}
    assert [got[i] for i, *_ in train] == [w[0] for w in _brute(train, [x for _, x, _ in train], 5, 1)]
    # one row many times, from many batches
    copies = [spark.range(100).select(F.lit(7).cast("long").alias("id"), F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), F.lit(1.0).alias("y")).coalesce(1)] * 3
    many = nb.fit_neighbours(df.unionByName(copies[0]).unionByName(copies[1]).unionByName(copies[2]), "id", ["a", "b"], "y", k=100)
    assert many.predict(spark.createDataFrame([(1.0, 1.0)], "a double, b double"), ["a"]).first().neighbours == [7] * 100


@pytest.mark.parametrize("spread", [1.0, 1e200, 1e-9])
def test_steps_give_the_same_neighbours(spread):
    rng = np.random.default_rng(8)
    for shape, far in (((9000, 20), 0.0), ((5000, 64), 5.0), ((300, 5), 0.0)):
        b = rng.normal(size=shape) + far
        b[:, 0] *= spread
        b[1] = b[200]
        a = np.concatenate([b[195:203], rng.normal(size=(24, shape[1])) * 2 + far])
        steps = nb.make_steps(b)
        for k in (1, 6, 150):
            want, got = nb.nearest(a, b, k, 1), nb.nearest_by_steps(a, b, steps, k)
            assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
            limit = want[1][:, -1] * rng.choice([0.5, 1.0], len(a))
            got, sure = nb.nearest_by_steps(a, b, steps, k, limit), want[1] <= limit[:, None]
            assert (got[0][sure] == want[0][sure]).all()
    assert nb.make_steps(np.ones((5, 3))) is None and nb.make_steps(rng.normal(size=(5, 400))) is None


def test_grid_cells_learn_from_all_rows(spark, twins, tmp_path):
    """j11_grid_runner."""
    picks = spark.createDataFrame([("s", f, "y", "a", 1, True) for f in (0, 1)], "selector string, fold int, target string, feature string, rank int, kept boolean")
    axes = {"features": ["raw"], "selector": ["s"], "target": ["y"], "model": ["knn"], "samples": [3]}
    got = cl.meta_grid(spark, str(tmp_path / "grid"), {"raw": twins}, picks, axes, 2).collect()
    assert [(r.b_acc, r.f1, r.roc) for r in got] == [(1.0, 1.0, 1.0)] * 2


def test_cross_validation_learns_from_all_rows(spark, twins):
    """j5_nearest_neighbours_cv."""
    got = ln.cross_validate(twins, lambda f, t: ["a"], ["y"], 2, "knn").collect()
    assert [(r.b_acc, r.f1, r.roc) for r in got] == [(1.0, 1.0, 1.0)] * 2


def test_cells_of_a_grid_search_learn_from_all_rows(spark, twins):
    """j6_grid_any_model."""
    for params in ({"n_neighbors": 1, "p": 1}, {"n_neighbors": 6, "p": 2}):
        out, m = ln.fit_cell(twins, 0, "y", ["a"], "knn", [0.0, 1.0], 42, params)
        assert isinstance(m, nb.CellModel) and m.k == params["n_neighbors"]
        assert out.agg(F.count(F.lit(1)), F.count_if((F.col("pred") == F.col("y")) & (F.array_max("probs") == 1))).first() == (ROWS // 2, ROWS // 2)
    # a bound that a caller names holds
    _, small = ln.fit_cell(twins, 0, "y", ["a"], "knn", [0.0, 1.0], 42, {"max_train_rows": 20})
    assert len(small.keys) == 20


def test_experiment_cells_learn_from_all_rows(spark, tmp_path):
    """l3_experiment_runs."""
    d = spark.range(30_500).select(F.col("id").alias("entity"), F.pmod(F.xxhash64("id"), F.lit(10 ** 6)).cast("double").alias("a"),
                                   F.pmod(F.xxhash64(F.col("id") + 7), F.lit(2)).cast("double").alias("y")).localCheckpoint()
    every = {"all": lambda f, feats, targets: sel.base_selector(f, "entity", feats, targets, 1).withColumn("kept", F.lit(True))}
    got = ex.run_experiment(spark, str(tmp_path / "runs"), {"raw": (d, ["a"])}, every, ["knn"], ["y"], repeats=1).collect()
    split = ex.hold_out(d, "entity", 0).toPandas()
    train, test = split[split.fold == ex.TRAIN], split[split.fold == ex.TEST]
    assert len(train) > 20_000 and len(got) == 1
    a, key, y = train.a.to_numpy(np.int64), train.entity.to_numpy(), train.y.to_numpy()
    # distance and key in one number
    near = np.stack([np.argpartition(np.abs(a - v) * 100_000 + key, 6)[:6] for v in test.a.to_numpy(np.int64)])
    pred, truth = (y[near].sum(axis=1) > 3).astype(float), test.y.to_numpy()
    assert got[0].b_acc == pytest.approx(np.mean([(pred[truth == c] == c).mean() for c in (0, 1)]), abs=1e-12)
