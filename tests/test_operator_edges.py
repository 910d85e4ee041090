"""Degenerate inputs through every scaler, cleaner and target builder: all-null column,
constant column, +-inf, one-row groups.  Nothing may raise (ANSI mode is on)."""

import pytest
from pyspark.sql import functions as F

from featurelab.operators import cleaning as cl
from featurelab.operators import collinear as co
from featurelab.operators import crafting as cr
from featurelab.operators import profiling as pf
from featurelab.operators import reporting as rp
from featurelab.operators import scaling as sc
from featurelab.operators import targets as tg


@pytest.fixture(scope="module")
def odd(spark):
    inf = float("inf")
    return spark.createDataFrame([(1, 1.0, None, 5.0, 2.0), (2, 2.0, None, 5.0, inf), (3, 4.0, None, 5.0, -1.0)],
                                 "entity long, a double, n double, c double, i double")


def test_degenerate_inputs_do_not_raise(spark, odd):
    k = ["entity"]
    sc.standard_scale(odd, k).collect()
    sc.minmax_scale(odd, k).collect()
    sc.winsorise(odd, k).collect()
    sc.quantile_transform(odd, k, 10).collect()
    out = sc.power_transform(odd.select("entity", "a", "c"), k).collect()
    assert all(r.c == 0.0 for r in out)                 # constant column: lambda 1, then 0 after scaling
    chain, suffix = sc.scale_chain(odd.select("entity", "a", "c", "n"), k, ["standard", "minmax"])
    assert suffix == "standard_minmax" and "c" not in chain.columns
    assert cl.clean_features(odd, "entity").columns == ["entity", "a", "i"]
    assert cl.duplicate_columns(odd, "entity", ["a", "n", "c", "i"]) == []
    tg.abs_perf_classes(odd.select("entity", "a", "c", "n")).collect()
    tg.rel_perf_classes(odd.select("entity", "a", "c", "n")).collect()
    assert len(co.vif_elimination(odd.select("entity", "a", "c"), k, 5.0)) == 2
    pf.statistical(odd.withColumn("e", F.lit(1)), "e", ["a", "n", "c"]).collect()
    assert rp.summaries(odd.withColumn("g", F.lit("x")), ["g"], "n").collect()[0].n == 0
    one = spark.createDataFrame([(0, 1.0, 1.0, 0.9)], "fold int, y double, pred double, p double")
    assert rp.score_table(one, ["fold"]).collect()[0].roc is None
    cr.add_noise(odd, "entity", 2, "gamma", 1, 2).collect()
    cr.add_noise(odd, "entity", 2, "poisson").collect()
