"""Exact top-k search: tiles of queries and candidates, partial selection, tree merge.

Candidates are dealt by id into shards of about ``TILE_ROWS`` and queries into blocks of
``TILE_QUERIES``.  Every (block, shard) pair is one group of bounded size whose scores are
one matrix product; it returns k rows per query.  The lists are merged ``FAN_IN`` shards at
a time until one list per query is left, so no task sees all lists of a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurelab.session import ship_package

TILE_ROWS, TILE_QUERIES, FAN_IN = 4096, 1024, 32
_EXACT = 1 << 53                     # integers that float64 holds exactly


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point only where every partial sum is exact."""
    top = lambda x: int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0
    bound = top(q) * top(c) * max(1, q.shape[1])
    if bound < _EXACT:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q @ c.T
    limit = 2**63 - 1
    return np.clip(q.astype(object) @ c.astype(object).T, -limit, limit).astype(np.int64)


def _matrix(t: pa.Table, dim: int) -> np.ndarray:
    return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim).astype(np.int64)


def _tile_top(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("query_hash", pa.int64()), ("shard", pa.int64()),
                        ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        queries, cands = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
        if not queries.num_rows or not cands.num_rows:
            return schema.empty_table()
        dim, shard = t.column("dim")[0].as_py(), t.column("shard")[0].as_py()
        cands = cands.sort_by("id")                       # ties then go to the smaller id
        ids, qids = cands.column("id").to_numpy(), queries.column("id").to_numpy()
        scores = _product(_matrix(queries, dim), _matrix(cands, dim))
        qi, ci = [], []
        for i, row in enumerate(scores):
            lo, hi = np.searchsorted(ids, qids[i], "left"), np.searchsorted(ids, qids[i], "right")
            other = np.delete(np.arange(len(row)), slice(lo, hi)) if hi > lo else np.arange(len(row))
            vals = row[other]
            if len(vals) > k:
                floor = np.partition(vals, len(vals) - k)[len(vals) - k]
                above, equal = np.flatnonzero(vals > floor), np.flatnonzero(vals == floor)
                other = other[np.concatenate((above, equal[:k - len(above)]))]
            qi.append(np.full(len(other), i))
            ci.append(other)
        qi, ci = np.concatenate(qi), np.concatenate(ci)
        return pa.Table.from_arrays(
            [pa.array(qids[qi]), queries.column("hash").combine_chunks().take(pa.array(qi)),
             pa.array(np.full(len(qi), shard, np.int64)), pa.array(ids[ci]), pa.array(scores[qi, ci])], schema=schema)
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for every row with ``is_query`` the k best rows.

    Components become floor(scale * x); the score is the integer inner product; ties go to
    the smaller vec_id.  Candidates are all rows but those with the query's own id.  Rows
    with a null id or vector, or a null or non-finite component, take no part; vectors are
    compared with those of the same length only (empty ones score 0).  A query repeated as
    a whole counts once; the same id with another vector is a query of its own.  Fewer than
    k candidates are all returned; an empty table gives no rows.  Further columns are not read.
    """
    ship_package(vectors.sparkSession)
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"),
                            is_query.alias("asks"))
             .filter(F.col("id").isNotNull() & F.col("x").isNotNull() & finite)
             .select("id", F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"),
                     F.size("x").cast("long").alias("dim"), F.coalesce("asks", F.lit(False)).alias("asks")))
    n, n_asks = valid.agg(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // TILE_ROWS)), max(1, -(-n_asks // TILE_QUERIES))
    deal = lambda seed, parts: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>"))
    queries = (valid.filter("asks").distinct()
               .select("id", "v", "dim", F.xxhash64("v").alias("hash"), F.lit(True).alias("asks"),
                       deal(1, blocks).alias("block"), each(shards).alias("shard")))
    cands = valid.select("id", "v", "dim", F.lit(None).cast("long").alias("hash"), F.lit(False).alias("asks"),
                         each(blocks).alias("block"), deal(2, shards).alias("shard"))
    lists = (cands.unionByName(queries).groupBy("shard", "block", "dim")
             .applyInArrow(_tile_top(k), "query_id long, query_hash long, shard long, vec_id long, score long"))
    best = [F.desc("score"), "vec_id"]
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        w = Window.partitionBy("query_id", "query_hash", "shard").orderBy(*best)
        lists = (lists.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
                 .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank"))
    w = Window.partitionBy("query_id", "query_hash").orderBy(*best)
    return (lists.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
