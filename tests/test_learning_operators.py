"""Nearest neighbours, cell ledger, permutation importance, one-against-one scores and the search
for lambda against brute force; inputs that earlier versions got wrong."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from featurelab.functions import concordance, keyed, moments, order_stats, ranks
from featurelab.operators import collinear as co
from featurelab.operators import crafting as cr
from featurelab.operators import experiment as ex
from featurelab.operators import importance as im
from featurelab.operators import ledger
from featurelab.operators import learning as ln
from featurelab.operators import neighbours as nb
from featurelab.operators import profiling as pf
from featurelab.operators import reporting as rp
from featurelab.operators import scaling as sc
from featurelab.operators import selectors as sel
from featurelab.plans import catalog as C
from tests.conftest import SF_CHECK


# ---- J5

@pytest.mark.parametrize("p", [1, 2])
def test_nearest_against_brute_force(monkeypatch, p):
    monkeypatch.setattr(nb, "TILE_TRAIN", 7)
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, (40, 3)).astype(float), rng.integers(0, 4, (53, 3)).astype(float)   # many ties
    for k in (1, 6, 53, 80):
        index, dist = nb.nearest(a, b, k, p)
        d = (np.abs(a[:, None] - b[None]) ** p).sum(axis=2)
        want = np.argsort(d, axis=1, kind="stable")[:, :k]
        assert (index == want).all() and (dist == np.take_along_axis(d, want, 1)).all()


@pytest.mark.parametrize("p", [1, 2])
def test_leaves_give_the_same_neighbours(monkeypatch, p):
    rng = np.random.default_rng(4)
    # grid values tie, copies tie at 0, one column does not vary, one row is far from all
    b = np.column_stack([rng.integers(0, 6, 900), np.round(rng.normal(size=900), 1), np.full(900, 2.0)]).astype(float)
    b[:80] = b[500]
    a = np.concatenate([b[480:600], rng.normal(size=(60, 3)) * 3, [[1e6, -1e6, 0.0]]])
    monkeypatch.setattr(nb, "MOST_LEFT", 1.0)
    monkeypatch.setattr(nb, "GATHERED", 1000)
    for k in (1, 6, 70):
        got, want = nb.nearest_by_leaves(a, nb.make_leaves(b, k), k, p), nb.nearest(a, b, k, p)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    monkeypatch.setattr(nb, "MOST_LEFT", 0.0)
    assert nb.nearest_by_leaves(a, nb.make_leaves(b, 6), 6, p) is None
    assert nb.make_leaves(np.array([[np.inf]]), 1) is None and nb.make_leaves(b[:0], 1) is None


def test_few_leaves_are_read(monkeypatch):
    rng = np.random.default_rng(6)
    b, a, read = rng.normal(size=(4000, 3)), rng.normal(size=(256, 3)), []
    real = nb._smallest
    monkeypatch.setattr(nb, "_smallest", lambda rows, *more: (read.append(len(rows)), real(rows, *more))[1])
    got = nb.nearest_by_leaves(a, nb.make_leaves(b, 6), 6, 1)
    assert sum(read) < 256 * 4000 / 10               # merged candidates, not all pairs
    assert (got[0] == nb.nearest(a, b, 6, 1)[0]).all()


def test_predictions_of_infinite_and_null_rows(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), float(i % 2)) for i in range(100)], "entity long, a double, b double, y double")
    m = nb.fit_neighbours(df, "entity", ["a", "b"], "y", k=3)
    test = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 1.0), (3, float("inf"), 1.0)], "entity long, a double, b double").coalesce(1)
    out = m.predict(test, ["entity"])
    got = {r.entity: r for r in out.collect()}
    assert got[2].neighbours is None and len(got[3].neighbours) == 3
    want = nb.nearest(np.array([[2.0, 3.0]]), m.x, 3, 1)[0][0].tolist()
    assert got[1].neighbours == want and got[1].probability == [sum(m.label[i] == c for i in want) / 3 for c in (0, 1)]
    # one file of test rows does not leave all distances to one task
    assert out.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rows_are_predicted_once(spark, monkeypatch):
    plans, real = [], rp.score_table
    monkeypatch.setattr(rp, "score_table", lambda pred, *more: (plans.append(pred._jdf.queryExecution().executedPlan().toString()), real(pred, *more))[1])
    df = spark.createDataFrame([(i, i % 3, float(i % 7), float(i % 2)) for i in range(90)], "entity long, fold int, a double, y double")
    assert ln.cross_validate(df, lambda f, t: ["a"], ["y"], 3, "knn").count() == 3
    assert len(plans) == 1 and "InArrow" not in plans[0]      # every score reads stored predictions


def test_neighbour_model(spark):
    rows = [(i, float(i % 9), float(i % 4), [0.0, 1.0, 5.0][i % 3] if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    m = nb.fit_neighbours(df, "id", ["a", "b"], "y", k=5)
    assert m.classes == [0.0, 1.0, 5.0] and len(m.keys) == 181 and m.keys == sorted(m.keys)
    test = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 1.0)], "id long, a double, b double")
    got = {r.id: r for r in m.predict(test, ["id"]).collect()}
    assert got[2].prediction is None and got[2].probability is None
    near = sorted((abs(r[1] - 2.0) + abs(r[2] - 3.0), r[0], r[3]) for r in rows if r[3] is not None)[:5]
    assert [m.keys[i] for i in got[1].neighbours] == [i for _, i, _ in near]
    votes = [sum(y == c for _, _, y in near) / 5 for c in m.classes]
    assert got[1].probability == votes and got[1].prediction == m.classes[int(np.argmax(votes))]
    # the bound: the rows of smallest keyed number, whatever the partitions
    small = nb.fit_neighbours(df, "id", ["a", "b"], "y", max_train_rows=20)
    again = nb.fit_neighbours(df.repartition(7), "id", ["a", "b"], "y", max_train_rows=20)
    assert len(small.keys) == 20 and small.keys == again.keys
    with pytest.raises(ValueError):
        nb.fit_neighbours(df.withColumn("a", F.when(F.col("id") > 3, F.col("a"))), "id", ["a", "b"], "y")
    none = nb.fit_neighbours(df.limit(0), "id", ["a", "b"], "y").predict(test, ["id"]).collect()
    assert all(r.prediction is None for r in none)


def test_cross_validation_of_three_classes(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, float(y), *(rng.normal(size=2) + (2 * y, 0)).tolist()) for i, y in enumerate(rng.integers(0, 3, 240).tolist())]
    df = spark.createDataFrame(rows, "entity long, fold int, y double, a double, b double")
    for model in ("knn", "logreg"):
        s = ln.cross_validate(df, lambda f, t: ["a", "b"], ["y"], 3, model).collect()
        assert len(s) == 3 and all(r.roc > 0.8 for r in s)
    with pytest.raises(Exception, match="null|Null"):
        ln.cross_validate(df.withColumn("a", F.when(F.col("entity") != 5, F.col("a"))), lambda f, t: ["a"], ["y"], 3, "logreg")


def test_auc_without_a_class(spark):
    rows = [(0, 0.0, [.6, .3, .1]), (0, 1.0, [.2, .7, .1]), (0, 1.0, [.6, .3, .1]), (1, 2.0, [.1, .1, .8]), (1, 2.0, [.1, .2, .7])]
    df = spark.createDataFrame(rows, "g int, y double, probs array<double>")
    got = {r.g: r.roc for r in rp.roc_auc_ovo(df, ["g"], [0.0, 1.0, 2.0]).collect()}
    assert got == {0: pytest.approx((0.75 + 0.75) / 2)}          # group 1 has one class only


def test_f1_of_predictions_outside_the_classes(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 1.0, 3.0), (0, 0.0, 0.0)], "g int, y double, pred double")
    assert rp.weighted_f1(df, ["g"]).first()["f1"] == pytest.approx((2 / 3 * 2 + 1.0) / 3)


# ---- J11

def test_ledger_goes_on_where_it_stopped(spark, tmp_path):
    path = str(tmp_path / "ledger")
    cells = ledger.grid(spark, {"model": ["a", "b", "c"], "n": [1, 2]}, skip=lambda c: c["model"] == "c" and c["n"] == 2)
    assert cells.count() == 5
    ran = []

    def run(cell, fail=()):
        ran.append((cell["model"], cell["n"]))
        if (cell["model"], cell["n"]) in fail:
            raise RuntimeError("killed")
        return spark.range(cell["n"]).select(F.col("id").alias("x"))
    with pytest.raises(RuntimeError, match="killed"):
        ledger.run_grid(spark, path, cells, lambda c: run(c, {("b", 1)}), threads=1)
    first = list(ran)
    # a folder without the committer's mark is an unfinished cell: not read, and written over
    broken = ledger.cell_id({"model": "b", "n": 1})
    spark.range(50).select(F.col("id").alias("x")).write.parquet(f"{path}/cell_id={broken}")
    (tmp_path / "ledger" / f"cell_id={broken}" / "_SUCCESS").unlink()
    out = ledger.run_grid(spark, path, cells, run)
    want = sorted((m, n, x) for m, n in [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)] for x in range(n))
    assert sorted(tuple(r) for r in out.select("model", "n", "x").collect()) == want
    assert sorted(set(first[:-1]) | set(ran[len(first):])) == sorted({w[:2] for w in want}) and len(ran) == 6
    # nothing left to run; a grown grid runs its new cells only
    assert ledger.run_grid(spark, path, cells, run).count() == len(want) and len(ran) == 6
    grown = ledger.grid(spark, {"model": ["a", "d"], "n": [1, 2]})
    assert ledger.run_grid(spark, path, grown, run).count() == 6 and len(ran) == 8


def test_cells_without_rows_are_finished(spark, tmp_path):
    cells = ledger.grid(spark, {"a": [1, 2]})
    ran = []

    def run(cell):
        ran.append(cell)
        return spark.range(3).where(F.col("id") < 0)
    for _ in range(2):
        assert ledger.run_grid(spark, str(tmp_path / "l"), cells, run).count() == 0
    assert len(ran) == 2


# ---- L1

def test_permutation_importance_of_trees(spark):
    df = C.planted_frame(spark, SF_CHECK)
    feats = C.PLANTED_FEATS[:5]
    data = ln.assemble(df, feats, ["y"]).withColumnRenamed("y", "label")
    model = RandomForestClassifier(numTrees=10, maxDepth=4, seed=1).fit(data)
    acc = lambda out: F.avg((F.col("prediction") == F.col("_y")).cast("double"))
    got = im.permutation_importance(df, "entity", feats, "y", model.transform, acc, repeats=2).toPandas()
    assert len(got) == 10 and got.groupby("repeat").score.nunique().max() == 1
    mean = got.groupby("feature").importance.mean()
    assert set(mean.nlargest(2).index) == {"e00", "e01"} and mean["e00"] > 0.05


def test_pairs_are_a_permutation(spark):
    df = spark.range(101).select("id", F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    a = {r._key: r._z[0] for r in im.paired(df, "id", ["x"], "y", 0).collect()}
    b = {r._key: r._z[0] for r in im.paired(df.repartition(9), "id", ["x"], "y", 0).collect()}
    other = {r._key: r._z[0] for r in im.paired(df, "id", ["x"], "y", 1).collect()}
    assert a == b and a != other and sorted(a.values()) == [float(i) for i in range(101)]


# ---- P1, order statistics, moments

def test_ranges_equal_one_bucket(spark):
    """Groups of very different sizes, 92 % of the values equal, a null group."""
    df = spark.range(6000).select(
        "id", F.when(F.col("id") % 100 < 92, 1.0).otherwise(F.col("id") % 37).alias("v"),
        F.when(F.col("id") < 5000, F.lit("x")).when(F.col("id") < 5020, F.lit(None)).otherwise(F.lit("y")).alias("g"))
    many = ranks.row_position(df, ["g"], "v", ["id"], "p", rows_per_bucket=100)
    one = ranks.row_position(df, ["g"], "v", ["id"], "p")
    assert sorted(map(tuple, many.collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    plan = many._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_range_tot" in line for line in windows)      # over the table of offsets only


def test_neighbours_in_small_groups(spark):
    rng = np.random.default_rng(5)
    rows = [("big" if i < 400 else "small", i, float(np.round(rng.normal(), 1))) for i in range(420)]
    df = spark.createDataFrame(rows, "g string, id long, v double").withColumn("_rid", F.col("id").cast("string"))
    got = ranks.neighbour_distances(df, ["g"], "v", 3, rows_per_bucket=50).toPandas()
    for g in ("big", "small"):
        order = sorted((v, str(i)) for x, i, v in rows if x == g)
        part = got[got.g == g].set_index("_rid")
        assert len(part) == len(order)
        for at, (v, rid) in enumerate(order):
            for j in range(1, 4):
                lag, lead = part.loc[rid, f"_lag{j}"], part.loc[rid, f"_lead{j}"]
                assert (np.isnan(lag) if at < j else lag == v - order[at - j][0])
                assert (np.isnan(lead) if at + j >= len(order) else lead == order[at + j][0] - v)


def test_brackets_equal_states(spark):
    rng = np.random.default_rng(0)
    rows = [("a" if i < 4000 else None if i < 5000 else f"c{i % 20}", float(rng.normal()),
             float(rng.integers(5)) if rng.random() < .92 else 3.3, None if rng.random() < .3 else float(rng.exponential()) * 1e6, None)
            for i in range(5500)]
    df = spark.createDataFrame(rows, "g string, a double, `b.x` double, c double, n double").cache()
    feats, ps = ["a", "b.x", "c", "n"], [0.5, 0.0, 0.25, 0.75, 1.0]

    def got(groups, **how):
        return {(r["g"] if groups else 0, r["feature"]): r["quantiles"] for r in order_stats.exact_quantiles(df, groups, feats, ps, **how).collect()}
    for groups in ([], ["g"]):
        state, bracket = got(groups), got(groups, state_cells=2000)
        assert state.keys() == bracket.keys() and all(state[k] == pytest.approx(bracket[k], rel=1e-14) for k in state)
    assert order_stats._by_brackets(df.select(F.col("a").alias("_c0")), [], ["_c0"], ps) is not None


def test_moments_with_nulls_and_large_means(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    x[rng.random((300, 4)) < .2] = np.nan
    x[:, 3] = np.nan
    fold = np.arange(300) % 3
    for shift in (0.0, 1e9):
        rows = [(int(f), *(None if np.isnan(v) else float(v) + shift for v in r)) for f, r in zip(fold, x)]
        df = spark.createDataFrame(rows, "fold int, a double, b double, c double, n double")
        blocks = moments.fold_moments(df, ["a", "b", "c", "n"], "fold")
        total = blocks[0] + blocks[1] + blocks[2]
        for part, rows_of in ((total, np.full(300, True)), (total - blocks[1], fold != 1)):
            want = pd.DataFrame(x[rows_of]).corr().to_numpy()
            got = part.correlation()
            assert np.allclose(got, want, atol=1e-6 if shift else 1e-12, equal_nan=True)
    assert np.isnan(co.correlation_matrix(df, ["a", "n"], "pearson")[0, 1])
    assert co.collinear_drop_list(df, ["a", "n"]) == [] and moments.fold_moments(df.limit(0), ["a"]) == {}


def test_rank_correlations_with_nulls(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(150, 3)), 1)
    x[:, 2] += x[:, 0]
    x[rng.random(150) < .3, 1] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    frame = pd.DataFrame(x)
    both = frame.dropna()
    want = np.array([[frame[[0, 2]].rank().corr().iloc[0, 1] if {i, j} == {0, 2} else
                      (1.0 if i == j else both[[i, j]].rank().corr().iloc[0, 1]) for j in range(3)] for i in range(3)])
    got = co.correlation_matrix(df, ["a", "b", "c"], "spearman")
    off = ~np.eye(3, dtype=bool)
    assert np.allclose(got[off], want[off])


@pytest.mark.parametrize("bucket", [1_000_000, 9])
def test_kendall_against_all_pairs(spark, bucket):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, (90, 3)).astype(float)
    x[:, 1] += x[:, 0]
    rows = [(*(float(v) for v in r), None if i % 4 == 0 else float(r[0] + i % 3), 1.0) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, k double")
    pairs = [("a", "b"), ("a", "c"), ("a", "d"), ("a", "k")]
    got = concordance.kendall(df, pairs, bucket_points=bucket)
    assert got[("a", "k")] is None
    for a, b in pairs[:3]:
        v = [(r["abcdk".index(a)], r["abcdk".index(b)]) for r in rows if r["abcdk".index(b)] is not None]
        s = [(np.sign(p[0] - q[0]), np.sign(p[1] - q[1])) for i, p in enumerate(v) for q in v[:i]]
        want = sum(i * j for i, j in s) / np.sqrt(float(sum(i * i for i, _ in s)) * float(sum(j * j for _, j in s)))
        assert got[(a, b)] == pytest.approx(want, abs=1e-12)


def test_inversions_against_all_pairs():
    rng = np.random.default_rng(9)
    for m in (0, 1, 2, 40):
        a, b, w = rng.integers(0, 8, m), rng.integers(0, 8, m), rng.integers(1, 5, m)
        want = sum(int(w[i] * w[j]) for i in range(m) for j in range(m) if a[i] < a[j] and b[i] > b[j])
        assert concordance.inversions(a, b, w) == want


# ---- selectors, reports, crafting, scaling

def test_f_value_is_free_of_the_mean(spark):
    rng = np.random.default_rng(10)
    rows = [(i, i % 3, float(i % 2), float(rng.normal() + i % 2), None if i % 5 == 0 else float(rng.normal())) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, fold int, y double, a double, b double")
    base = {(r.fold, r.feature): (r.score, r.n) for r in sel.f_value_selector(df, "id", ["a", "b"], ["y"], 3).collect()}
    for shift, tol in ((1e6, 1e-8), (1e9, 1e-5)):
        moved = df.select("id", "fold", "y", (F.col("a") + shift).alias("a"), (F.col("b") + shift).alias("b"))
        for r in sel.f_value_selector(moved, "id", ["a", "b"], ["y"], 3).collect():
            assert r.score == pytest.approx(base[(r.fold, r.feature)][0], rel=tol)
    for (fold, f), (score, n) in base.items():
        groups = [np.array([r[3 + "ab".index(f)] for r in rows if r[1] != fold and r[2] == y and r[3 + "ab".index(f)] is not None]) for y in (0.0, 1.0)]
        all_ = np.concatenate(groups)
        between = sum(len(g) * (g.mean() - all_.mean()) ** 2 for g in groups)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups)
        assert n == len(all_) and score == pytest.approx(between / (within / (len(all_) - 2)))


def test_bins_do_not_see_the_test_fold(spark):
    rng = np.random.default_rng(11)
    rows = [(i, i % 3, float(rng.integers(0, 2)), float(rng.normal())) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, fold int, y double, a double")
    far = df.withColumn("a", F.when(F.col("fold") == 0, F.col("a") * 1000 + 77).otherwise(F.col("a")))
    score = lambda d: {r.fold: r.score for r in sel.mutual_info_selector(d, "id", ["a"], ["y"], 3).collect()}
    assert score(df)[0] == pytest.approx(score(far)[0], rel=1e-12) and score(df)[1] != pytest.approx(score(far)[1], rel=1e-6)


def test_stability_counts_empty_runs(spark):
    kept = spark.createDataFrame([("g", 0, "a"), ("g", 1, "a")], "g string, run int, feature string")
    runs = spark.createDataFrame([("g", 0), ("g", 1), ("g", 2), ("h", 0), ("h", 1)], "g string, run int")
    got = {r.g: r.jaccard for r in rp.jaccard_stability(kept, "run", ["g"], runs=runs).collect()}
    assert got == {"g": pytest.approx(1 / 3), "h": 0.0}


def test_rows_without_an_entity_stay(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 9.0)], "entity string, v double")
    for method in ("standard", "minmax", "robust"):
        assert pf.rescale_per_entity(df, "entity", ["v"], method).count() == 4


def test_pairs_cost_their_number():
    names = [f"c{i}" for i in range(100_000)]
    t = time.time()
    pairs = cr.pick_pairs(names, 100, 1)
    assert time.time() - t < 1 and len(set(pairs)) == 100
    every = cr.pick_pairs(names[:9], 99, 1)
    assert sorted(every) == sorted((a, b) for i, a in enumerate(names[:9]) for b in names[i + 1:9])
    assert cr.pick_pairs(names[:1], 5, 1) == [] and cr.pick_pairs(names[:2], 5, 1) == [("c0", "c1")]


def test_noise_of_any_parameter(spark):
    df = spark.range(4000).select("id", keyed.keyed_poisson(1, 120.0, F.col("id")).alias("p"), keyed.keyed_gamma(1, 2.5, F.col("id")).alias("g"),
                                  keyed.keyed_gamma(1, 0.3, F.col("id")).alias("h"))
    p, g, h = (df.toPandas()[c].to_numpy() for c in "pgh")
    assert abs(p.mean() - 120) < 1 and abs(p.var() - 120) < 12 and p.max() > 140
    assert abs(g.mean() - 2.5) < .1 and abs(g.var() - 2.5) < .3 and abs(h.mean() - .3) < .05 and (h > 0).all()


def test_lambda_against_a_fine_search(spark):
    rng = np.random.default_rng(12)
    cols = {"steep": 1 + np.exp(rng.normal(size=400)) ** -1.0 * 0.1, "skew": np.exp(rng.normal(size=400)), "left": -np.exp(rng.normal(size=400)),
            "plain": rng.normal(size=400), "large": 10 - np.exp(rng.normal(size=400) * 0.5)}
    df = spark.createDataFrame(list(zip(*(c.tolist() for c in cols.values()))), ", ".join(f"{c} double" for c in cols)) \
              .withColumn("flat", F.lit(3.0)).withColumn("none", F.lit(None).cast("double"))
    got = sc.power_lambdas(df, [*cols, "flat", "none"])
    assert got.keys() == cols.keys()
    assert got["steep"] < -3 and got["large"] > 3

    def loss(x, lam):
        y = sc.yeo_johnson_values(x, np.array(lam))
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()
    for c, x in cols.items():
        lo, hi = got[c] - 0.5, got[c] + 0.5
        for _ in range(60):
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (a, hi) if loss(x, a) < loss(x, b) else (lo, b)
        assert abs(got[c] - (lo + hi) / 2) < 1e-4


# ---- L1 of any model in one pass

def test_permuted_columns_are_predicted_in_one_pass(spark):
    """Each score equals that of a pass of its own; the model is asked once a repeat, and the
    rows are spread over tasks whatever the number of files."""
    rng = np.random.default_rng(3)
    rows = [(i, float(i % 2), *map(float, r)) for i, r in enumerate(rng.normal(size=(400, 3)))]
    df = spark.createDataFrame(rows, "entity long, y double, a double, b double, c double").coalesce(1)
    asked = []

    def predict(frame):
        asked.append(frame.rdd.getNumPartitions())
        v = vector_to_array("features")
        return frame.withColumn("prediction", (v[0] + 0.5 * v[1] > 0).cast("double"))
    right = lambda out: F.avg((F.col("prediction") == F.col("_y")).cast("double"))
    got = im.permutation_importance(df, "entity", ["a", "b", "c"], "y", predict, right, repeats=2, seed=5).collect()
    assert len(asked) == 2 and len(got) == 6 and min(asked) >= 2 * spark.sparkContext.defaultParallelism
    for r in range(2):
        pairs = im.paired(df, "entity", ["a", "b", "c"], "y", r, 5).collect()
        x, z, y = (np.array([p[c] for p in pairs]) for c in ("_x", "_z", "_y"))
        score = lambda v: np.mean((v[:, 0] + 0.5 * v[:, 1] > 0) == y)  # noqa: B023, E731
        for j, name in enumerate("abc"):
            w = x.copy()
            w[:, j] = z[:, j]
            one = next(g for g in got if (g.feature, g["repeat"]) == (name, r))
            assert abs(one.score - score(x)) < 1e-12 and abs(one.permuted - score(w)) < 1e-12
            assert abs(one.importance - (score(x) - score(w))) < 1e-12


def test_splits_are_stored_once(spark):
    df = spark.range(300).select(F.col("id").alias("entity"), (F.col("id") % 7).cast("double").alias("a.b"))
    df = df.withColumn("fold", F.lit(9))         # another fold gives way, as in hold_out
    for i, split in enumerate(ex._stored_splits(df, "entity", 3, 0.3, 42)):
        assert split.dtypes == ex.hold_out(df, "entity", i).dtypes
        assert sorted(map(tuple, split.collect())) == sorted(map(tuple, ex.hold_out(df, "entity", i).collect()))
        assert "md5" not in split._jdf.queryExecution().toString()
