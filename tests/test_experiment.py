"""Experiments against a plain recomputation of every cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelab.operators import crafting as cr
from featurelab.operators import experiment as ex
from featurelab.operators import learning as ln
from featurelab.operators import selectors as sel

FEATS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    z = (x[:, 1] - x[:, 2] > 0).astype(float)
    rows = [(i, *map(float, r), float(s), float(t)) for i, (r, s, t) in enumerate(zip(x, y, z))]
    return spark.createDataFrame(rows, "entity long, a double, b double, c double, d double, y double, z double").cache()


def _f_value(x, y):
    n, groups = len(x), [x[y == c] for c in (0, 1)]
    between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups)
    return between / (sum(((g - g.mean()) ** 2).sum() for g in groups) / (n - 2))


def test_experiment_cells(spark, toy, tmp_path):
    nothing = lambda d, f, t: sel.base_selector(d, "entity", f, t, 1).withColumn("kept", F.lit(False))
    methods = {"f_value": lambda d, f, t: sel.f_value_selector(d, "entity", f, t, 1), "nothing": nothing}
    calls = []

    def counted(d, f, t):
        calls.append(1)
        return methods["f_value"](d, f, t)
    args = (["logreg", "knn"], ["y", "z"])
    path = str(tmp_path / "runs")
    got = ex.run_experiment(spark, path, {"raw": (toy, FEATS)}, {**methods, "f_value": counted}, *args, repeats=2).collect()
    again = ex.run_experiment(spark, path, {"raw": (toy, FEATS)}, {**methods, "f_value": counted}, *args, repeats=2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(calls) == 2
    assert {(r.method, r.target, r.model, r["repeat"]) for r in got} == {("f_value", t, m, i) for t in "yz" for m in args[0] for i in (0, 1)}
    for r in got:
        d = ex.hold_out(toy, "entity", r["repeat"]).toPandas()
        train, test = d[d.fold == 1], d[d.fold == 0]
        assert 0.2 < len(test) / len(d) < 0.4 and r.n_features == 4
        scores = sel.f_value_selector(ex.hold_out(toy, "entity", r["repeat"]), "entity", FEATS, [r.target], 1).toPandas().set_index("feature")
        for f in FEATS:
            assert abs(scores.score[f] - _f_value(train[f].to_numpy(), train[r.target].to_numpy())) < 1e-6 * max(1, scores.score[f])
            assert scores.n[f] == len(train)
        kept = [f for f in FEATS if scores.kept[f]]
        assert r.n_selected == len(kept) > 0
        assert r.importance_fraction is None or abs(r.importance_fraction - 1) < 1e-12      # four columns: all are among the top
        if r.model == "knn":
            x, labels = train[kept].to_numpy(), train[r.target].to_numpy()
            order = [np.lexsort((train.entity, np.abs(x - v).sum(axis=1)))[:6] for v in test[kept].to_numpy()]
            pred = np.array([labels[o].sum() > 3 for o in order], float)
            truth = test[r.target].to_numpy()
            assert abs(r.b_acc - np.mean([(pred[truth == c] == c).mean() for c in (0, 1)])) < 1e-12


def test_recursive_selector_learns_from_training_rows(spark, toy):
    d = toy.withColumn("fold", (F.col("entity") % 3).cast("int"))
    got = ln.recursive_selector(d, FEATS, ["y", "z"], 3).toPandas()
    assert len(got) == 3 * 2 * 4 and (got.groupby(["fold", "target"]).kept.sum() == 2).all() and (got.n == 200).all()
    assert all("a" in set(g[g.kept].feature) for (_, t), g in got.groupby(["fold", "target"]) if t == "y")
    assert all(set(g[g.kept].feature) == {"b", "c"} for (_, t), g in got.groupby(["fold", "target"]) if t == "z")
    # other labels in the rows of a fold change nothing for that fold
    other = ln.recursive_selector(d.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y"))), FEATS, ["y"], 1).toPandas()
    mine = got[(got.target == "y") & (got.fold == 0)].set_index("feature")
    assert (other.set_index("feature").score - mine.score).abs().max() == 0
    one_class = ln.recursive_selector(d.withColumn("y", F.lit(1.0)), FEATS, ["y"], 1)
    assert one_class.count() == 0


def test_grid_search_tries_every_setting(spark, toy):
    lists = {"n_neighbors": [1, 5], "p": [1, 2]}
    best, score, table = ln.grid_search(toy, FEATS, "y", "knn", lists, k_inner=2, score="b_acc")
    rows = {r.params: r.score for r in table.collect()}
    assert list(rows) == [str(s) for s in ln.grid_settings(lists)] and len(rows) == 4
    assert score == max(rows.values()) == rows[str(best)]
    d = toy.withColumn("fold", (F.col("entity") % 2).cast("int"))
    run = ln.meta_model_run(d, FEATS, ["y"], 2, "knn", lists, search="grid").collect()
    assert {r.fold for r in run} == {0, 1} and all(r.best_params in rows for r in run)


def test_products_have_two_columns():
    for n in (2, 3, 7):
        made = cr.shift_sources(n, "second_order", 200)
        assert all(a != b and 0 <= a < n and 0 <= b < n for a, b in made)
        assert len({frozenset(m) for m in made}) == n * (n - 1) // 2
    with pytest.raises(ValueError):
        cr.shift_sources(1, "second_order", 1)


@pytest.mark.parametrize("scenario", ["random", "corrupted", "second_order"])
def test_wide_and_long_shifts_agree(spark, toy, scenario):
    d = toy.select("entity", *FEATS).where("entity < 20")
    wide = cr.shift_variants(d, "entity", scenario, 12).toPandas().set_index("entity")
    for r in cr.shift_variants_long(d, "entity", scenario, 12).collect():
        assert r.value == wide[r.feature][r.entity]


def test_winsorise_then_power_on_raw_columns(spark):
    """Every column has the likelihood of its best lambda on a fine grid of far values."""
    from featurelab.operators import scaling as sc
    rng = np.random.default_rng(8)
    x = np.stack([rng.normal(0.05, 0.003, 400), rng.lognormal(9, 1, 400), rng.normal(-40, 5, 400)], axis=1)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "entity long, a double, b double, c double")
    cut = sc.winsorise(df, ["entity"]).toPandas().sort_values("entity")
    out, suffix = sc.scale_chain(df, ["entity"], ["power"], remove_outliers=True)
    got = out.toPandas().sort_values("entity")
    assert suffix == "power" and out.columns == df.columns
    lams = sc.power_lambdas(sc.winsorise(df, ["entity"]), ["a", "b", "c"])

    def transformed(v, lam):
        pos, neg = np.log1p(np.maximum(v, 0)), np.log1p(np.maximum(-v, 0))
        up = pos if abs(lam) < 1e-12 else np.expm1(lam * pos) / lam
        down = neg if abs(lam - 2) < 1e-12 else np.expm1((2 - lam) * neg) / (2 - lam)
        return np.where(v >= 0, up, -down)

    def likelihood(v, lam):
        return -len(v) / 2 * np.log(transformed(v, lam).var()) + (lam - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()
    for c in "abc":
        v = cut[c].to_numpy()
        best = max(likelihood(v, lam) for lam in np.arange(lams[c] - 3, lams[c] + 3, 0.01))
        assert likelihood(v, lams[c]) >= best - 1e-6
        want = transformed(v, lams[c])
        assert np.allclose(got[c], (want - want.mean()) / want.std(), atol=1e-6)
