"""A1-A4: stage write / read / memoisation (scratch folder per run)."""

import tempfile

from pyspark.sql import functions as F

from featurelab.sources.store import memoised_stage, read_stage, stage_exists, write_stage
from featurelab.sources.tables import normalise_nan, read_csv_table


def test_memoised_stage_skips_and_reads_back(spark):
    root = tempfile.mkdtemp(prefix="featurelab-stage-")
    path = f"{root}/filtered"
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumn("x", F.col("id") * 2.0)
    a = memoised_stage(spark, path, build)
    b = memoised_stage(spark, path, build)
    assert len(calls) == 1 and stage_exists(spark, path)
    assert sorted(r.x for r in a.collect()) == sorted(r.x for r in b.collect()) == [0.0, 2.0, 4.0, 6.0, 8.0]
    memoised_stage(spark, path, build, rewrite=True)
    assert len(calls) == 2


def test_csv_with_schema_and_key_first(spark):
    root = tempfile.mkdtemp(prefix="featurelab-csv-")
    df = spark.createDataFrame([(1.5, "a"), (float("nan"), "b")], "`f__x.y.z` double, dataset_name string")
    write_stage(df, f"{root}/t", fmt="csv")
    back = read_csv_table(spark, f"{root}/t", "`f__x.y.z` double, dataset_name string", key="dataset_name")
    assert back.columns == ["dataset_name", "f__x.y.z"]
    clean = normalise_nan(back, ["f__x.y.z"]).orderBy("dataset_name").collect()
    assert clean[0][1] == 1.5 and clean[1][1] is None
    assert read_stage(spark, f"{root}/t", fmt="csv", schema="a double, b string").count() == 2
