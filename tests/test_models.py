"""R rows: planted-signal checks and NumPy brute-force twins (SF 0.001 / small frames)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelab.functions.linalg import fold_gramians
from featurelab.operators import causal as ca
from featurelab.operators import collinear as co
from featurelab.operators import learning as ln
from featurelab.operators import projection as pj
from featurelab.plans import catalog as C
from tests.conftest import SF_CHECK


@pytest.fixture(scope="module")
def planted(spark):
    return C.planted_frame(spark, SF_CHECK)


def test_fold_gramians_match_numpy(spark, planted):
    cols = C.PLANTED_FEATS[:5]
    g = fold_gramians(planted, cols, "fold")
    pdf = planted.select("fold", *cols).toPandas()
    for k, m in g.items():
        x = pdf[pdf.fold == k][cols].to_numpy()
        assert np.allclose(m, x.T @ x, rtol=1e-10)


def test_vif_matches_regression(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    x[:, 3] = x[:, 0] + 0.1 * rng.normal(size=200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    got = dict(co.vif_elimination(df, [], value_threshold=None, count_threshold=0))
    for i, name in enumerate("abcd"):
        others = np.delete(x, i, axis=1)
        beta, *_ = np.linalg.lstsq(others, x[:, i], rcond=None)
        resid = x[:, i] - others @ beta
        r2 = 1 - resid @ resid / (x[:, i] @ x[:, i])   # uncentred, no intercept
        assert abs(got[name] - 1 / (1 - r2)) < 1e-6 * got[name]


def test_planted_signal_found_by_model_selectors(spark, planted):
    for model in ("gbt_small", "l1_logreg"):
        res = ln.model_selector(planted, C.PLANTED_FEATS, ["y"], 3, model).toPandas()
        for fold in range(3):
            top = res[res.fold == fold].assign(a=lambda d: d.score.abs()).nlargest(2, "a").feature
            assert set(top) == {"e00", "e01"}, (model, fold, list(top))


def test_double_ml_recovers_planted_columns(spark, planted):
    res = ca.double_ml_selector(planted, C.PLANTED_FEATS, ["y"], 3).toPandas()
    for fold in range(3):
        top = res[res.fold == fold].assign(a=lambda d: d.score.abs()).nlargest(2, "a").feature
        assert set(top) == {"e00", "e01"}


def test_projection_matches_numpy_rrr(spark, planted):
    feats = C.PLANTED_FEATS[:6]
    a, u, err = pj.fit_projection(planted, feats, ["y"])
    pdf = planted.select(*feats, "y").toPandas()
    x = pdf[feats].to_numpy()
    v = pdf[feats + ["y"]].to_numpy()
    approx = x @ a.T @ u.T
    assert abs(((v - approx) ** 2).sum() - err) < 1e-6 * max(1.0, err)
    # no rank-2 map does better than the optimum: compare with random perturbations
    rng = np.random.default_rng(1)
    for _ in range(5):
        a2 = a + 0.01 * rng.normal(size=a.shape)
        z = x @ a2.T
        b2, *_ = np.linalg.lstsq(z, v, rcond=None)
        assert ((v - z @ b2) ** 2).sum() >= err - 1e-6


def test_counterfactual_cells_against_numpy(spark, planted):
    feats = C.PLANTED_FEATS[:4]
    df = planted.withColumn("e02", F.when(F.col("entity") % 5 == 0, None).otherwise(F.col("e02") * 100 + 1e4)) \
                .withColumn("z", F.when(F.col("entity") % 7 == 0, None).otherwise((F.col("e03") > 0.05).cast("double")))
    res = ca.counterfactual_selector(df, feats, ["y", "z"], 3).collect()
    assert len(res) == 24 and all(0 <= r.score <= 1 and r.kept == (r.score > 0) for r in res)
    pdf = df.select("fold", *feats, "y", "z").toPandas()
    for r in res:
        d = pdf[(pdf.fold != r.fold) & pdf[r.target].notna() & pdf[r.feature].notna()]
        x, y = d[r.feature].to_numpy(), d[r.target].to_numpy()
        p = 1 / (1 + np.exp(-(r.w * x + r.b)))
        scale = x.std()
        # stationary up to the ridge of 1e-6 on the scaled slope and intercept
        assert abs(((p - y) * (x - x.mean()) / scale).mean()) < 1e-4 and abs((p - y).mean()) < 1e-4
        mad = np.median(np.abs(x - np.median(x)))
        flips = (np.abs(x + r.b / r.w) < 5).mean() if abs(r.w) * mad > 0.4 else 0.0
        assert abs(flips - r.score) < 1e-12


def test_recursive_elimination_keeps_planted(spark, planted):
    kept = ln.recursive_elimination(planted, C.PLANTED_FEATS[:8], "y", "logreg", step=0.25)
    assert {"e00", "e01"} <= set(kept) and len(kept) == 4


def test_exact_folds_sizes(spark):
    from featurelab.operators.sampling import assign_folds
    df = spark.range(0, 101).withColumnRenamed("id", "entity")
    sizes = sorted(r[1] for r in assign_folds(df, "entity", 3, 42, exact=True).groupBy("fold").count().collect())
    assert sizes == [33, 34, 34]
    # partition count does not change the assignment
    a = dict(assign_folds(df.repartition(1), "entity", 3, 42).select("entity", "fold").collect())
    b = dict(assign_folds(df.repartition(13), "entity", 3, 42).select("entity", "fold").collect())
    assert a == b


def test_double_ml_matches_numpy_cross_fitting(spark, planted):
    """Outside each test fold; with intercepts, so a shift of any column changes nothing."""
    feats = C.PLANTED_FEATS[:5]
    pdf = planted.select("fold", *feats, "y").toPandas()
    x_all, y_all, fold = pdf[feats].to_numpy(), pdf["y"].to_numpy(), pdf.fold.to_numpy()
    exp = {}
    for test in range(3):
        thetas = []
        for g in range(3):
            if g == test:
                continue
            tr, te = (fold != test) & (fold != g), fold == g
            x, y = x_all[tr], y_all[tr]
            xc, yc = x - x.mean(axis=0), y - y.mean()
            row = []
            for j in range(len(feats)):
                o = [i for i in range(len(feats)) if i != j]
                cov = xc[:, o].T @ xc[:, o] / len(xc)
                a = cov + 1e-3 * np.diag(np.diag(cov))
                bj = np.linalg.solve(a, xc[:, o].T @ xc[:, j] / len(xc))
                by = np.linalg.solve(a, xc[:, o].T @ yc / len(xc))
                xt = x_all[te] - x.mean(axis=0)
                rj = xt[:, j] - xt[:, o] @ bj
                ry = y_all[te] - y.mean() - xt[:, o] @ by
                row.append((ry @ rj) / (rj @ rj))
            thetas.append(row)
        for f, v in zip(feats, np.mean(thetas, axis=0)):
            exp[(test, f)] = v
    moved = planted.select("fold", *[(F.col(f) + 50.0 * i).alias(f) for i, f in enumerate(feats)], (F.col("y") + 5.0).alias("y"))
    for df in (planted, moved):
        got = {(r.fold, r.feature): r.score for r in ca.double_ml_selector(df, feats, ["y"], 3, ridge=1e-3).collect()}
        assert got.keys() == exp.keys()
        assert all(abs(got[k] - exp[k]) < 1e-8 * max(1.0, abs(exp[k])) for k in exp)
