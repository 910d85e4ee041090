"""A2-A4: writing and reading stage results.

A stage result is a parquet table in a folder per stage.  ``memoised_stage``
computes a stage only when its output does not exist yet and then always reads
the stored table back (the reference returns nothing when it skips a stage).
Splits, slices and selections are ordinary tables here (keyed by entity or
feature name, not by row position), so A4 is the same code path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))


def stage_exists(spark: SparkSession, path: str) -> bool:
    return _path_exists(spark, path)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_stage(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
        if schema is None:
            raise ValueError("csv stages are read with an explicit schema")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def memoised_stage(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                   rewrite: bool = False, partition_by: list[str] | None = None) -> DataFrame:
    """A3: skip the stage when its output exists (unless ``rewrite``), then read it back."""
    if rewrite or not stage_exists(spark, path):
        write_stage(build(), path, partition_by=partition_by)
    return read_stage(spark, path)
