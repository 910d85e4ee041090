"""Edge fixtures for the selectors: single class, one-row class, empty fold, no outliers."""

import math

from featurelab.operators import cleaning as cl
from featurelab.operators import selectors as sel


def _df(spark, rows):
    return spark.createDataFrame(rows, "entity long, fold int, a double, b double, y double")


def test_single_class_target_keeps_nothing(spark):
    rows = [(i, i % 3, float(i), float(i % 5), 1.0) for i in range(30)]
    df = _df(spark, rows)
    for res in (sel.correlation_selector(df, "entity", ["a", "b"], ["y"], 3),
                sel.chi2_selector(df, "entity", ["a", "b"], ["y"], 3),
                sel.f_value_selector(df, "entity", ["a", "b"], ["y"], 3)):
        out = res.collect()
        assert len(out) == 6 and not any(r.kept for r in out)
    assert sel.empty_selections(sel.correlation_selector(df, "entity", ["a", "b"], ["y"], 3)).count() == 3


def test_ksg_ignores_class_with_one_row(spark):
    rows = [(i, i % 3, float(i), float((i * 7) % 11), float(i % 2)) for i in range(60)]
    rows.append((99, 0, 1000.0, 5.0, 7.0))       # class 7 has one row
    df = _df(spark, rows)
    res = {(r.fold, r.feature): r for r in
           sel.ksg_mutual_info_selector(df, "entity", ["a", "b"], ["y"], 3).collect()}
    # the one-row class is dropped, so n counts the 40 training rows of classes 0/1 only
    assert all(r.n == 40 for r in res.values())
    assert all(r.score >= 0 and not math.isnan(r.score) for r in res.values())


def test_empty_fold_trains_on_everything(spark):
    rows = [(i, i % 2, float(i), float(i % 3), float(i % 2 == 0)) for i in range(40)]  # fold 2 empty
    df = _df(spark, rows)
    res = {(r.fold, r.feature): r for r in sel.f_value_selector(df, "entity", ["a", "b"], ["y"], 3).collect()}
    assert res[(2, "a")].n == 40 and res[(0, "a")].n == 20
    sp = {(r.fold, r.feature): r for r in sel.correlation_selector(df, "entity", ["a", "b"], ["y"], 3).collect()}
    assert sp[(2, "a")].n == 40


def test_no_outliers_at_all(spark):
    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(5)], "entity long, a double, b double")
    out = cl.filter_outliers(df, ["entity"], 1e6)
    assert out.columns == df.columns and out.count() == 5
