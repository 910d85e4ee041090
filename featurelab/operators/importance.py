"""L1 for any scorer: permutation importance.

A column is permuted by joining two position frames: the row at position i of one keyed
random order gets the values of the row at position i of another.  The join happens once
per repeat, on whole feature vectors; every column is then scored from the same pairs by
replacing one entry, all in one pass, so no copy of the table is stored or shuffled per column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.functions.keyed import keyed_uniform
from featurelab.functions.ranks import row_position
from featurelab.functions.wide import q
from featurelab.session import cut_lineage, dealt


def paired(df: DataFrame, key: str, features: list[str], target: str, repeat: int, seed: int = 42) -> DataFrame:
    """(_key, _y, _x, _z): the features of every row and those of the row that a keyed random
    permutation of the rows gives it.  Keys are distinct; rows without a target take no part."""
    x = F.array(*[q(f).cast("double") for f in features])
    rows = df.where(q(target).isNotNull()).select(q(key).alias("_key"), q(target).cast("double").alias("_y"), x.alias("_x"))

    def order(name: str, frame: DataFrame) -> DataFrame:
        u = keyed_uniform(seed, F.lit(f"perm{repeat}{name}"), F.col("_key"))
        return row_position(frame.withColumn("_u", u), [], "_u", ["_key"], "_pos").drop("_u")
    giver = order("b", rows.select("_key", F.col("_x").alias("_z"))).drop("_key")
    return order("a", rows).join(giver, "_pos").drop("_pos")


def linear_permutation_importance(df: DataFrame, key: str, weights: dict[str, float], intercept: float, target: str,
                                  repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, repeat, score, permuted, importance) of the rule ``w . x + intercept > 0`` on a 0/1 target, by accuracy.

    One aggregate per repeat scores all columns: replacing an entry changes the sum by
    w_j * (z_j - x_j), so a row costs as many steps as it has features.  Rows with a null
    feature are never predicted right."""
    feats, n = list(weights), len(weights)
    w = F.array(*[F.lit(float(weights[f])) for f in feats])
    parts = []
    for r in range(repeats):
        pairs = paired(df, key, feats, target, r, seed)
        total = F.aggregate(F.zip_with("_x", w, lambda a, b: a * b), F.lit(float(intercept)), lambda s, v: s + v)
        right = lambda s: F.avg(F.coalesce((s > 0).cast("double") == F.col("_y"), F.lit(False)).cast("double"))
        change = [F.col("_s") + F.lit(float(weights[f])) * (F.get("_z", F.lit(i)) - F.get("_x", F.lit(i))) for i, f in enumerate(feats)]
        scored = pairs.withColumn("_s", total).agg(right(F.col("_s")).alias("score"), F.array(*[right(c) for c in change]).alias("p"))
        names = F.array(*[F.lit(f) for f in feats])
        parts.append(scored.select(F.lit(r).alias("repeat"), "score", F.posexplode("p").alias("i", "permuted"))
                     .select(F.element_at(names, F.col("i") + 1).alias("feature"), "repeat", "score", "permuted"))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("importance", F.col("score") - F.col("permuted"))


def permutation_importance(df: DataFrame, key: str, features: list[str], target: str,
                           predict: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], Column],
                           repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, repeat, score, permuted, importance) of any model.

    ``predict`` maps a frame with the vector column ``features`` to one with predictions and the
    frame's other columns (``model.transform`` of a Spark ML model); ``score`` gives the aggregate of
    such a frame (label ``_y``) in which larger is better.  The pairs of a repeat are written once and
    dealt evenly; one pass over them predicts every pair as it is and with each column replaced.
    The copies of a row are made where they are predicted and are not shuffled."""
    spark, n = df.sparkSession, len(features)
    rows = []
    for r in range(repeats):
        pairs = dealt(cut_lineage(paired(df, key, features, target, r, seed)))
        each = pairs.select("*", F.explode(F.array(*[F.lit(j) for j in range(-1, n)])).alias("_column"))
        x = F.transform("_x", lambda v, i: F.when(i == F.col("_column"), F.get("_z", i)).otherwise(v))
        out = predict(each.select("_key", "_y", "_column", array_to_vector(x).alias("features")))
        scores = dict(out.groupBy("_column").agg(score(out).cast("double")).collect())
        base = scores[-1]
        rows += [(features[j], r, base, scores[j], base - scores[j]) for j in range(n)]
    return spark.createDataFrame(rows, "feature string, repeat int, score double, permuted double, importance double")


def summary(importances: DataFrame) -> DataFrame:
    """Mean and sample deviation of the importance over repeats."""
    return importances.groupBy("feature").agg(F.avg("importance").alias("importance"), F.stddev_samp("importance").alias("sd"))
