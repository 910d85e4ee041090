"""Written tables that cut lineage, in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from featurelab.session import TASKS_PER_CORE, ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder; every executor can read and write it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later jobs restart from
    the files, so a lost executor costs no recomputation and unused columns are not read.
    ``narrow``: the rows are short and cheap to make after their last shuffle, so a few tasks
    per core take its partitions one after another, and there are only so many files."""
    path = shared_path(df.sparkSession, name)
    if narrow:
        df = df.coalesce(TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_1``, ``name_2``... that no column of ``df`` has (any case)."""
    taken = {c.lower() for c in df.columns}
    out, i = name, 0
    while out.lower() in taken:
        i += 1
        out = f"{name}_{i}"
    return out
