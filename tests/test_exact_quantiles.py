"""Quantiles are the interpolated percentile at every size, also when a column spans many value buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelab.functions import order_stats, ranks, wide
from featurelab.operators import cleaning, formatting, profiling, scaling, targets


@pytest.fixture
def table(spark, monkeypatch):
    # groups are too large for one state, so values are bracketed; running counts use ranges
    monkeypatch.setattr(order_stats, "STATE_CELLS", 10)
    monkeypatch.setattr(ranks.running_sum_before, "__defaults__", (50,))
    rng = np.random.default_rng(3)
    rows = [(None if i % 7 == 0 else f"e{int(rng.integers(3)) if i % 2 else 0}", float(rng.integers(40)) * 2.5,
             None if i % 5 == 0 else float(rng.normal()), None) for i in range(600)]
    return spark.createDataFrame(rows, "entity string, a double, `b.x` double, n double")


def _values(rows, c, e=0):
    return [r[c] for r in rows if r[c] is not None and (e == 0 or r["entity"] == e)]


def test_column_quantiles_are_exact(table):
    rows = table.collect()
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = targets.quantile_edges(table, ["a", "b.x", "n"], 4)
    assert got["n"] is None
    for c in ("a", "b.x"):
        assert got[c] == pytest.approx(list(np.quantile(_values(rows, c), [0, 0.25, 0.5, 0.75, 1])), rel=1e-12)
    assert wide.column_quantiles(table, ["b.x"], ps)["b.x"] == pytest.approx(list(np.quantile(_values(rows, "b.x"), ps)), rel=1e-12)
    filled = {r["b.x"] for r in cleaning.fill_undefined(table, ["entity"]).collect()}
    assert any(v == pytest.approx(np.median(_values(rows, "b.x")), rel=1e-12) for v in filled) and None not in filled
    q1, q3 = np.quantile(_values(rows, "b.x"), [0.25, 0.75])
    clipped = [r["b.x"] for r in scaling.winsorise(table, ["entity"], 0.1).collect() if r["b.x"] is not None]
    assert max(clipped) == pytest.approx(q3 + 0.1 * (q3 - q1), rel=1e-12)


def test_grouped_quantiles_are_exact(table):
    rows = table.collect()
    stats = {r["entity"]: r for r in profiling.statistical(table, "entity", ["a", "b.x", "n"]).collect()}
    assert stats.keys() == {"e0", "e1", "e2", None}
    robust = profiling.rescale_per_entity(table, "entity", ["b.x"], "robust").collect()
    folds = {r["entity"]: r for r in formatting.collapse_folds(table, "entity", approx=None).collect()}
    for e, r in stats.items():
        q1, q2, q3 = np.quantile(_values(rows, "b.x", e), [0.25, 0.5, 0.75])
        assert r["f__profile.statistical.median.b.x"] == pytest.approx(q2, rel=1e-12)
        assert r["f__profile.statistical.iq_range.b.x"] == pytest.approx(q3 - q1, rel=1e-12)
        assert r["f__profile.statistical.median.n"] is None
        if e is not None:
            assert folds[e]["b.x"] == pytest.approx(q2, rel=1e-12) and folds[e]["n"] is None
            assert sorted(_values(robust, "b.x", e)) == pytest.approx(sorted((v - q2) / (q3 - q1) for v in _values(rows, "b.x", e)))


def test_more_statistics_and_summaries(table):
    data = table.withColumn("c", F.when(F.col("a") > 95, F.lit(1000.0)).otherwise(F.col("a") * F.col("a")))
    rows = data.collect()
    got = {r["entity"]: r for r in profiling.statistical_more(data, "entity", ["b.x", "c", "n"]).collect()}
    assert got.keys() == {"e0", "e1", "e2", None}
    for e, r in got.items():
        name = "f__profile.statistical."
        for c in ("b.x", "c"):
            v = np.array(_values(rows, c, e))
            q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
            assert r[f"{name}var.{c}"] == pytest.approx(v.var())
            assert r[f"{name}mad.{c}"] == pytest.approx(np.median(np.abs(v - q2)))
            assert r[f"{name}outlier_share.{c}"] == pytest.approx(((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))).mean())
        both = np.array([(x["b.x"], x["c"]) for x in rows if x["entity"] == e and x["b.x"] is not None])
        assert r[f"{name}cor.b.x.c"] == pytest.approx(np.corrcoef(both.T)[0, 1])
        assert r[f"{name}var.n"] is None and r[f"{name}mad.n"] is None and r[f"{name}outlier_share.n"] is None


def test_summaries(spark):
    v = [3.0, 1.0, 4.0, 1.5, 9.0, 2.0]
    names = [f"f__profile.statistical.mean.c{i}" for i in range(7)]
    df = spark.createDataFrame([("e", *v, None), ("none", *[None] * 7)], "entity string, " + ", ".join(f"`{n}` double" for n in names))
    every = ("mean", "sd", "min", "max", "median", "range", "iq_range", "skewness", "kurtosis", "count", "quantiles", "histogram")
    r, none = profiling.summarise(df, "entity", [f"c{i}" for i in range(7)], ["mean"], every).orderBy("entity").collect()
    x = np.array(v)
    z = (x - x.mean()) / x.std()
    qs = np.quantile(x, [0, 0.25, 0.5, 0.75, 1])
    want = [x.mean(), x.std(), 1, 9, qs[2], 8, qs[3] - qs[1], (z ** 3).mean(), (z ** 4).mean() - 3, 6, *qs, *np.histogram(x, 10)[0] / 6]
    assert list(r)[1:] == pytest.approx(want)
    assert none["f__profile.statistical.mean.count"] == 0 and sum(c is not None for c in none) == 2
