"""Kendall's tau-b of column pairs by distributed inversion counting.

Equal (x, y) are counted first.  In the order of (x, y) and in the order of (y, x) a pair of
points is discordant exactly if the two orders disagree, ties included, so the discordant
pairs are the weighted inversions between two positions.  Both orders are cut into buckets
of equal numbers of points; an inversion is then of one of three kinds: both points in one
x bucket (counted in that bucket), in one y bucket but not one x bucket (counted in that
y bucket), or in neither (from the table of bucket counts).  No pair of points is formed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.functions.ranks import row_position
from featurelab.functions.wide import q
from featurelab.session import cut_lineage, ship_package

#: Points per bucket, and the most buckets an order has (so the bucket table has at most its
#: square of cells): buckets grow once there are more points than their product.
BUCKET_POINTS, MAX_BUCKETS = 1_000_000, 1024


def inversions(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> int:
    """Weighted pairs with a_i < a_j and b_i > b_j, by bits of the rank of b: O(m log^2 m)."""
    if len(a) < 2:
        return 0
    order = np.lexsort((b, a))           # equal a: ascending b, no inversion
    rank = np.unique(b[order], return_inverse=True)[1].astype(np.int64)
    weight = w[order].astype(np.int64)
    total = 0
    for bit in range(int(rank.max()).bit_length()):
        # pairs whose ranks first differ at this bit: earlier ones with 1, later ones with 0
        group = rank >> (bit + 1)
        at = np.argsort(group, kind="stable")
        one = (rank[at] >> bit) & 1
        seen = np.cumsum(weight[at] * one)
        first = np.flatnonzero(np.concatenate(([True], group[at][1:] != group[at][:-1])))
        base = np.repeat(np.concatenate(([0], seen))[first], np.diff(np.concatenate((first, [len(at)]))))
        total += int(((seen - base) * weight[at] * (1 - one)).sum())
    return total


def _in_bucket(a: str, b: str):
    def run(t: pa.Table) -> pa.Table:
        d = inversions(t.column(a).to_numpy(), t.column(b).to_numpy(), t.column("w").to_numpy())
        return pa.table({"pair": t.column("pair").slice(0, 1), "d": pa.array([d], pa.decimal128(38, 0))})
    return run


def _across(cells: np.ndarray) -> int:
    """Inversions between points that share neither bucket, from (x bucket, y bucket, weight)."""
    if not len(cells):
        return 0
    grid = np.zeros((cells[:, 0].max() + 1, cells[:, 1].max() + 1), np.float64)
    np.add.at(grid, (cells[:, 0], cells[:, 1]), cells[:, 2])
    later = np.zeros_like(grid)          # points of smaller x bucket and larger y bucket
    later[1:, :-1] = np.cumsum(np.cumsum(grid, axis=0)[:, ::-1], axis=1)[:, ::-1][:-1, 1:]
    return int(sum(int(g) * int(n) for g, n in zip(grid[grid > 0].ravel(), later[grid > 0].ravel())))


def kendall(df: DataFrame, pairs: list[tuple[str, str]], bucket_points: int = BUCKET_POINTS) -> dict[tuple[str, str], float | None]:
    """{(a, b): tau-b} over the rows in which both columns are present; None where a column
    does not vary.  Counts are exact up to 2**53 rows per pair of buckets."""
    ship_package(df.sparkSession)
    if not pairs:
        return {}
    each = [F.when(q(a).isNotNull() & q(b).isNotNull(),
                   F.struct(F.lit(i).alias("pair"), q(a).cast("double").alias("x"), q(b).cast("double").alias("y")))
            for i, (a, b) in enumerate(pairs)]
    points = cut_lineage(df.select(F.explode(F.array(*each)).alias("s")).where(F.col("s").isNotNull())
                         .groupBy("s.pair", "s.x", "s.y").agg(F.count(F.lit(1)).alias("w")))
    ties = lambda *by: points.groupBy("pair", *by).agg(F.sum("w").cast("decimal(38,0)").alias("t")) \
        .groupBy("pair").agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).cast("decimal(38,0)")).collect()
    n0, n1, n2, n3 = ({r[0]: int(r[1]) for r in ties(*by)} for by in ([], ["x"], ["y"], ["x", "y"]))
    most = points.groupBy("pair").count().agg(F.max("count")).first()[0] or 0
    size = max(bucket_points, math.ceil(most / MAX_BUCKETS))
    placed = row_position(row_position(points, ["pair"], "x", ["y"], "px"), ["pair"], "y", ["x"], "py")
    placed = cut_lineage(placed.select("pair", "px", "py", "w", F.floor((F.col("px") - 1) / size).cast("int").alias("bx"),
                                       F.floor((F.col("py") - 1) / size).cast("int").alias("by")))
    kind = "pair int, d decimal(38,0)"
    same_x = placed.select("pair", "bx", "px", "py", "w").groupBy("pair", "bx").applyInArrow(_in_bucket("px", "py"), kind)
    same_y = placed.select("pair", "by", "bx", "py", "w").groupBy("pair", "by").applyInArrow(_in_bucket("bx", "py"), kind)
    found = {r[0]: int(r[1]) for r in same_x.unionByName(same_y).groupBy("pair").agg(F.sum("d").cast("decimal(38,0)")).collect()}
    out: dict[tuple[str, str], float | None] = {}
    for i, ab in enumerate(pairs):
        if most > size:                  # a pair at a time: its table has at most MAX_BUCKETS ** 2 cells
            t = placed.where(F.col("pair") == i).groupBy("bx", "by").agg(F.sum("w").alias("w")).toArrow()
            found[i] = found.get(i, 0) + _across(np.stack([t.column(c).to_numpy() for c in ("bx", "by", "w")], axis=1))
        all_, tx, ty, both = (m.get(i, 0) for m in (n0, n1, n2, n3))
        d = found.get(i, 0)
        out[ab] = None if all_ in (tx, ty) else (all_ - tx - ty + both - 2 * d) / math.sqrt((all_ - tx) * (all_ - ty))
    return out
