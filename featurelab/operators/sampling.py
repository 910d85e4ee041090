"""H1-H5: folds, hold-out splits and column slices.

Rows are assigned by key, not by position: a fold is a pure function of
(seed, key), so it is independent of partitioning and survives recomputation.
``exact=True`` reproduces the reference's fold *sizes* (first n mod k folds get
one more row) from a distributed position in keyed-random order (P1).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurelab.functions.keyed import keyed_bucket, keyed_uniform
from featurelab.functions.ranks import row_position


def assign_folds(df: DataFrame, key: str, k: int = 3, seed: int = 42, exact: bool = False,
                 out: str = "fold") -> DataFrame:
    """H1: shuffled K-fold.  ``out`` = test fold of the row; it trains in the others."""
    if not exact:
        return df.withColumn(out, keyed_bucket(seed, k, F.col(key)))
    n = df.count()
    base, extra = divmod(n, k)
    pos = row_position(df.withColumn("_u", keyed_uniform(seed, F.col(key))), [], "_u", [key], "_pos")
    p = F.col("_pos") - 1
    big = extra * (base + 1)
    fold = F.when(p < big, (p / F.lit(base + 1)).cast("int")) \
            .otherwise(F.lit(extra) + ((p - big) / F.lit(max(base, 1))).cast("int"))
    return pos.withColumn(out, fold.cast("int")).drop("_u", "_pos")


def shuffle_split(df: DataFrame, key: str, test_size: float = 0.3, seed: int = 42,
                  repeat: int = 0, exact: bool = False, out: str = "is_test") -> DataFrame:
    """H2/H5: one hold-out split; ``repeat`` is part of the key of the random draw."""
    u = keyed_uniform(seed, repeat, F.col(key))
    if not exact:
        return df.withColumn(out, u < test_size)
    n = df.count()
    n_test = math.ceil(test_size * n)
    pos = row_position(df.withColumn("_u", u), [], "_u", [key], "_pos")
    return pos.withColumn(out, F.col("_pos") <= n_test).drop("_u", "_pos")


def repeated_holdout(df: DataFrame, key: str, repeats: int = 5, test_size: float = 0.3,
                     seed: int = 42) -> DataFrame:
    """H5: (key, repeat, is_test) for ``repeats`` independent 70/30 splits."""
    reps = F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("repeat")
    base = df.select(key, reps)
    return base.withColumn("is_test", keyed_uniform(seed, F.col("repeat"), F.col(key)) < test_size)


def feature_frame(spark: SparkSession, features: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, f) for i, f in enumerate(features)], "pos int, feature string")


def slice_features(spark: SparkSession, features: list[str], slice_sizes: list[int] | None = None,
                   n_iter: int = 1, seed: int = 42) -> DataFrame:
    """H3: random column slices ``(slice, iter, feature)``; default one slice of all columns.

    The slice table has (sizes x iterations x F) rows of names only.
    """
    sizes = slice_sizes or [len(features)]
    ff = feature_frame(spark, features)
    grid = ff.select("pos", "feature",
                     F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"))
    grid = grid.select("*", F.explode(F.array(*[F.lit(i) for i in range(n_iter)])).alias("iter"))
    u = keyed_uniform(seed, F.col("size"), F.col("iter"), F.col("feature"))
    from pyspark.sql import Window
    w = Window.partitionBy("size", "iter").orderBy(u, "feature")
    return grid.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("size")) \
               .select(F.col("size").cast("string").alias("slice"), "iter", "feature")


def sample_uninformative(spark: SparkSession, features: list[str], percents: list[float],
                         n_iter: int = 1, seed: int = 42, sep: str = "___") -> DataFrame:
    """H4: all original columns + a random share of the crafted ones (told apart by ``sep``)."""
    crafted = [f for f in features if sep in f]
    ff = feature_frame(spark, features).withColumn("crafted", F.col("feature").contains(sep))
    grid = ff.select("feature", "crafted", F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("pct"))
    grid = grid.select("*", F.explode(F.array(*[F.lit(i) for i in range(n_iter)])).alias("iter"))
    n_take = F.floor(F.col("pct") * F.lit(len(crafted))).cast("int")
    u = keyed_uniform(seed, F.col("pct"), F.col("iter"), F.col("feature"))
    from pyspark.sql import Window
    w = Window.partitionBy("pct", "iter", "crafted").orderBy(u, "feature")
    ranked = grid.withColumn("_r", F.row_number().over(w))
    keep = (~F.col("crafted")) | (F.col("_r") <= n_take)
    return ranked.where(keep).select(F.col("pct").cast("string").alias("slice"), "iter", "feature")
