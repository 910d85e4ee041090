"""Edge fixtures for cleaning and targets (a few rows each)."""

import math

from featurelab.operators import cleaning as cl
from featurelab.operators import formatting as fm
from featurelab.operators import targets as tg


def _df(spark, rows, cols):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'entity' else 'double'}" for c in cols))


def test_unsuitable_constant_and_null(spark):
    cols = ["entity", "f__a.b.c", "f__a.b.const", "f__a.b.nulls", "f__a.b.const_with_null"]
    rows = [(1, 1.0, 5.0, None, 2.0), (2, 2.0, 5.0, None, None), (3, 3.0, 5.0, 1.0, 2.0)]
    out = cl.remove_unsuitable(_df(spark, rows, cols), ["entity"])
    # constant dropped; 2 of 3 nulls > 1.5 dropped; a null makes a column non-constant
    assert out.columns == ["entity", "f__a.b.c", "f__a.b.const_with_null"]


def test_outliers_no_column_with_two(spark):
    cols = ["entity", "a", "b"]
    rows = [(1, 1.0, 2e7), (2, 2.0, 1.0), (3, 3.0, 1.0)]
    out = cl.filter_outliers(_df(spark, rows, cols), ["entity"], 1e6)
    # only one outlier anywhere: no median -> no column dropped, the row goes
    assert out.columns == cols
    assert sorted(r.entity for r in out.collect()) == [2, 3]


def test_outliers_inf_and_median_rule(spark):
    cols = ["entity", "a", "b", "c"]
    inf = float("inf")
    rows = [(1, inf, 2e7, 1.0), (2, 2e7, 1.0, 1.0), (3, 2e7, 2e7, 1.0), (4, 2e7, 1.0, 1.0)]
    out = cl.filter_outliers(_df(spark, rows, cols), ["entity"], 1e6)
    # counts a=4, b=2 -> median 3: a dropped, rows with outliers in b dropped
    assert out.columns == ["entity", "b", "c"]
    assert sorted(r.entity for r in out.collect()) == [2, 4]


def test_duplicates_rows_and_columns(spark):
    cols = ["entity", "a", "b", "c"]
    rows = [(3, 1.0, 1.0, 0.0), (1, 1.0, 1.0, 0.0), (2, 2.0, 2.0, -0.0)]
    out = cl.drop_duplicates(_df(spark, rows, cols), "entity")
    assert out.columns == ["entity", "a", "c"]
    assert sorted(r.entity for r in out.collect()) == [1, 2]


def test_fill_median_all_null_stays(spark):
    cols = ["entity", "a", "b"]
    rows = [(1, 1.0, None), (2, None, None), (3, 3.0, None), (4, 10.0, None)]
    out = {r.entity: (r.a, r.b) for r in cl.fill_undefined(_df(spark, rows, cols), ["entity"]).collect()}
    assert out[2] == (3.0, None)


def test_remove_by_func_and_key(spark):
    cols = ["entity", "f__x.g.n", "f__x.g.n.sum", "f__x.g.n.mean", "f__x.g.n.mean.relative", "f__x.dbg.n.mean", "ab"]
    df = _df(spark, [(1, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], cols)
    out = cl.remove_by_key(cl.remove_by_func(df, ["sum"], ["entity"]), ["dbg"], ["entity"])
    assert out.columns == ["entity", "f__x.g.n", "f__x.g.n.mean", "ab"]


def test_collapse_folds_nan_and_null_key(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, float("nan")), (1, 2, 3.0), (None, 0, 5.0)],
                               "entity long, fold int, x double")
    out = fm.collapse_folds(df, "entity").collect()
    assert len(out) == 1 and out[0].x == 2.0


def test_round_half_even(spark):
    df = spark.createDataFrame([(1, 2.5), (2, 3.5)], "entity long, n double")
    assert [r.n for r in fm.round_counts(df, ["n"]).orderBy("entity").collect()] == [2.0, 4.0]


def test_abs_classes_constant_and_edges(spark):
    wide = spark.createDataFrame([(i, float(i), 7.0, None if i == 0 else float(i % 2)) for i in range(5)],
                                 "entity long, a double, b double, c double")
    out = {r.entity: r for r in tg.abs_perf_classes(wide).collect()}
    assert [out[i].a for i in range(5)] == [0.0, 0.0, 1.0, 1.0, 1.0]   # median 2 -> goes up
    assert all(out[i].b == 0.0 for i in range(5))                    # constant -> 0
    assert out[0].c == 0.0                                            # null lowest


def test_rel_classes_ties_favour_later_column(spark):
    wide = spark.createDataFrame([(1, 5.0, 5.0, 1.0, 0.0)], "entity long, a double, b double, c double, d double")
    r = tg.rel_perf_classes(wide).collect()[0]
    # ranks: b=1, a=2, c=3, d=4 -> edge 2.5 -> a,b better half
    assert (r.a, r.b, r.c, r.d) == (0.0, 0.0, 1.0, 1.0)
    assert not math.isnan(r.a)


def test_clean_metrics_exact_variant_set(spark):
    df = spark.createDataFrame([(1, "A", 1.0), (1, "B", 2.0), (2, "A", 1.0), (3, "A", 1.0), (3, "B", 1.0),
                                (3, "C", 1.0)], "entity long, variant string, metric double")
    out = cl.clean_metrics(df, variants=["A", "B"])
    assert sorted({r.entity for r in out.collect()}) == [1, 3]


def test_kmeans_edges_match_numpy_lloyd(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    a = np.concatenate([rng.normal(0, 1, 60), rng.normal(8, 1, 40), rng.normal(20, 2, 20)])
    b = rng.uniform(0, 1, 120)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))],
                               "entity long, a double, b double")
    got = tg.kmeans_edges(df, ["a", "b"], 3, tol=0.0)
    for col, x in (("a", a), ("b", b)):
        e = np.linspace(x.min(), x.max(), 4)
        c = (e[1:] + e[:-1]) / 2
        for _ in range(300):
            lab = np.argmin(np.abs(x[:, None] - c[None, :]), axis=1)
            new = np.array([x[lab == j].mean() if (lab == j).any() else c[j] for j in range(3)])
            if np.allclose(new, c, rtol=0, atol=0):
                break
            c = new
        c = np.sort(c)
        exp = [x.min(), *((c[1:] + c[:-1]) / 2), x.max()]
        assert np.allclose(got[col], exp, atol=1e-9)
    classes = tg.abs_perf_classes(df, n_bins=3, strategy="kmeans").groupBy("a").count().collect()
    assert sorted(r["a"] for r in classes) == [0.0, 1.0, 2.0]
