"""Distributed ranks without one task per group.

A plain ``Window.partitionBy(group).orderBy(value)`` sends every row of a group
(e.g. one feature in one fold) to one task that sorts it, and small groups together to
one task.  That is the right plan while the largest group (``ROWS_PER_BUCKET``) and all
together are small.  At scale a group has
billions of rows; then:

1. where ranks are wanted, ties are collapsed: ``groupBy(group, value).count()``;
2. rows are dealt by range of (group, value, tie-breaks), so that large groups and
   frequent values are split, and running sums come from prefix sums in each
   partition and a small table of offsets (``functions/ranges.py``).

Both plans give the same numbers.  ``average_rank`` reproduces the average rank of
tied values (the rank used by Spearman correlation); ``row_position`` gives distinct
1-based positions in a total order (value, tie-break columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelab.functions.ranges import ranged_sums_before

# Rows per group (or bucket) that one task is expected to sort comfortably.
ROWS_PER_BUCKET = 250_000
# Buckets in all groups together that one task may hold: adaptive execution merges partitions by
# bytes written, of which sorted narrow rows have few.
BUCKETS_PER_TASK = 4


def _range_parts(df: DataFrame, groups: list[str], rows_per_bucket: int) -> int:
    """0 if windows per group may be sorted by one task, else the number of range partitions:
    those of a shuffle, or more so that none is much larger than a bucket.  One small job counts the rows."""
    if groups:
        largest, total = (n or 0 for n in df.groupBy(*groups).count().agg(F.max("count"), F.sum("count")).first())
    else:
        largest = total = df.count()
    if largest <= rows_per_bucket and total <= BUCKETS_PER_TASK * rows_per_bucket:
        return 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // rows_per_bucket))


def sums_before(df: DataFrame, groups: list[str], order: list[str], weights: list[str], out: list[str],
                rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``out[i]`` = sum of ``weights[i]`` over rows strictly before each row in ``order``."""
    parts = _range_parts(df, groups, rows_per_bucket)
    if parts:
        return ranged_sums_before(df, groups, order, weights, out, parts)
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.select("*", *[F.coalesce(F.sum(x).over(w), F.lit(0)).alias(o) for x, o in zip(weights, out)])


def average_rank(df: DataFrame, groups: list[str], value: str, out: str = "rank",
                 rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``out`` = average rank (1-based) of ``value`` within ``groups``; null stays null."""
    ties = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = sums_before(ties, groups, [value], ["_n"], ["_before"], rows_per_bucket)
    ranked = ranked.select(*groups, value, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(out))
    return df.join(ranked, groups + [value], "left")


def row_position(df: DataFrame, groups: list[str], value: str, tiebreak: list[str],
                 out: str = "pos", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``out`` = 1-based position in the order (value, *tiebreak) within ``groups``."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    placed = sums_before(one, groups, [value, *tiebreak], ["_one"], ["_before"], rows_per_bucket)
    return placed.withColumn(out, F.col("_before") + 1).drop("_one", "_before")


def running_sum_before(df: DataFrame, groups: list[str], order: list[str], weight: str, out: str,
                       rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``out`` = sum of ``weight`` over rows strictly before each row in the order ``order``."""
    return sums_before(df, groups, order, [weight], [out], rows_per_bucket)


def neighbour_distances(df: DataFrame, groups: list[str], value: str, k: int, rows_per_bucket: int = ROWS_PER_BUCKET):
    """For every row: the distances to its k predecessors and k successors in (value, _rid)
    order within ``groups`` (columns _lag1.._lagk, _lead1.._leadk; null where missing).

    Rows are cut by position into buckets of ``rows_per_bucket`` rows (at least k), whatever
    the size of their group and however many values are equal.  Each bucket borrows the last
    k rows of the bucket before and the first k rows of the bucket after (a halo), so the
    lag/lead window runs over (group, bucket) and still sees the true neighbours.
    """
    size = max(rows_per_bucket, k)
    at = F.col("_pos") - 1
    b = row_position(df, groups, value, ["_rid"], "_pos", rows_per_bucket)
    b = b.select("*", F.floor(at / size).alias("_bucket"), (at % size).alias("_at"), F.lit(True).alias("_own"))
    tail = b.where(F.col("_at") >= size - k).withColumn("_bucket", F.col("_bucket") + 1).withColumn("_own", F.lit(False))
    head = b.where(F.col("_at") < k).withColumn("_bucket", F.col("_bucket") - 1).withColumn("_own", F.lit(False))
    u = b.unionByName(tail).unionByName(head)
    wo = Window.partitionBy(*groups, "_bucket").orderBy("_pos")
    for i in range(1, k + 1):
        u = u.withColumn(f"_lag{i}", F.col(value) - F.lag(value, i).over(wo)) \
             .withColumn(f"_lead{i}", F.lead(value, i).over(wo) - F.col(value))
    return u.where("_own").drop("_own", "_bucket", "_at", "_pos")


def fold_average_ranks(long_df: DataFrame, groups: list[str], value: str, k: int, fold: str = "fold",
                       prefix: str = "_r", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Average rank of every row's value among the TRAINING rows of each fold t (rows with
    fold != t), for t = 0..k-1, as columns ``{prefix}0 .. {prefix}{k-1}`` -- without copying
    rows to their training folds.

    Ties are collapsed to (group, value) with one count per fold; running counts of each
    fold's values below v (distributed, bucketed) give below_f(v); then for training set t
    below_t = sum_{f != t} below_f and the average rank is below_t + (ties_t + 1) / 2.
    """
    cnt = long_df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        *[F.sum(F.when(F.col(fold) == f, 1).otherwise(0)).alias(f"_n{f}") for f in range(k)])
    counts, below = [f"_n{f}" for f in range(k)], [f"_b{f}" for f in range(k)]
    run = sums_before(cnt, groups, [value], counts, below, rows_per_bucket)
    ranks = []
    for t in range(k):
        below = sum((F.col(f"_b{f}") for f in range(k) if f != t), F.lit(0))
        ties = sum((F.col(f"_n{f}") for f in range(k) if f != t), F.lit(0))
        ranks.append(F.when(ties > 0, below + (ties + 1) / 2.0).alias(f"{prefix}{t}"))
    table = run.select(*groups, value, *ranks)
    return long_df.join(table, groups + [value], "left")
