"""Inputs that earlier fixtures never produced: dependent columns, ties at the extremes."""

import math

import numpy as np

from featurelab.operators.collinear import vif_elimination
from featurelab.operators.scaling import quantile_transform


def test_vif_of_dependent_columns_is_infinite(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    rows = [(i, *map(float, r), float(r[0] + r[1])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    all_ = dict(vif_elimination(df, ["id"]))
    assert set(all_) == {"a", "b", "c", "d"}
    assert all(math.isinf(all_[f]) for f in "abd") and all_["c"] < 2
    left = dict(vif_elimination(df, ["id"], value_threshold=5.0))
    assert len(left) == 3 and "c" in left and max(left.values()) < 5


def test_quantile_ties_at_the_extremes(spark):
    df = spark.createDataFrame([(i, float(i >= 40)) for i in range(100)], "id long, x double")
    assert {(r.id >= 40, r.x) for r in quantile_transform(df, ["id"]).collect()} == {(False, 0.0), (True, 1.0)}
    df = spark.createDataFrame([(i, float(max(i - 20, 0))) for i in range(101)], "id long, x double")
    got = {r.id: r.x for r in quantile_transform(df, ["id"], 101).collect()}
    assert {got[i] for i in range(21)} == {0.0} and got[100] == 1.0
    assert all(abs(got[i] - i / 100) < 0.02 for i in range(21, 101))
    same = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, None)], "id long, x double")
    assert [r.x for r in quantile_transform(same, ["id"]).orderBy("id").collect()] == [0.0, 0.0, None]
