"""A1: reading tables.

Schemas are taken from parquet footers, never inferred from text.  Every
numeric input is normalised once at the boundary: NaN becomes null, so that
comparisons, ``max`` and percentiles skip missing values the way the reference
does; +-inf stays (the outlier filter must see it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
            T.FloatType, T.DoubleType, T.DecimalType)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read one driver table; ``columns`` prunes the parquet scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return df


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str,
                   key: str | None = None) -> DataFrame:
    """CSV with a given schema; the key column (if named) is moved first."""
    df = spark.read.csv(path, header=True, schema=schema)
    if key is not None and key in df.columns:
        df = df.select(F.col(f"`{key}`"), *[F.col(f"`{c}`") for c in df.columns if c != key])
    return df


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def normalise_nan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cast the numeric feature columns to double with NaN -> null."""
    cols = columns if columns is not None else numeric_columns(df)
    wanted = set(cols)
    return df.select(*[
        nan_to_null(F.col(f"`{c}`").cast("double")).alias(c) if c in wanted else F.col(f"`{c}`")
        for c in df.columns])
