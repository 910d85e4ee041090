"""Resharding by minimum-cost flow.

Shards are made of blocks (buckets of the text's hash, so that equal texts share a block).
The sizes of the old shards and the capacities of the new ones give a transportation
problem: a byte that stays costs nothing, a byte that moves costs one.  Its solution says
how many bytes go from each old shard to each new one; blocks are then dealt to fulfil it,
large ones first, and a last pass evens out what whole blocks leave over.  Only the block
table, of fixed size, is on the driver.  A block too large to balance with (a group of
copies may hold a third of all rows) is dealt in pieces.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stage import free_name, shared_path

BLOCKS = 1024                        # per old shard: bounds the block table on the driver
SPLIT_SHARE = 0.5                    # of a new shard: blocks are kept whole up to that size
CELL_ROWS, CELL_BYTES = 1_000, 128 << 20   # what is numbered together


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units from each source to each sink at least total cost, by shortest augmenting paths
    (Bellman-Ford on the residual graph).  The capacities must hold the whole supply."""
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        dist = [0 if left[i] else float("inf") for i in range(n)] + [float("inf")] * m
        back = [-1] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + cost[i][j] < dist[n + j]:
                        dist[n + j], back[n + j], changed = dist[i] + cost[i][j], i, True
                    if flow[i][j] and dist[n + j] - cost[i][j] < dist[i]:
                        dist[i], back[i], changed = dist[n + j] - cost[i][j], n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: dist[n + j])
        path, at = [], n + end
        while back[at] != -1:
            path.append((back[at], at))
            at = back[at]
        amount = min([left[at], room[end], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[at] -= amount
        room[end] -= amount
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def deal_blocks(units: list[tuple[tuple, int]], capacity: list[int]) -> dict[tuple, int]:
    """New shard of every unit ((old shard, block, piece), bytes)."""
    olds = sorted({key[0] for key, _ in units})
    supply = [sum(s for key, s in units if key[0] == o) for o in olds]
    cost = [[int(o != j) for j in range(len(capacity))] for o in olds]
    flow = min_cost_flow(supply, capacity, cost)
    out, load = {}, [0] * len(capacity)
    for i, o in enumerate(olds):
        want = list(flow[i])
        for key, s in sorted((u for u in units if u[0][0] == o), key=lambda u: (-u[1], u[0])):
            j = max(range(len(want)), key=lambda j: (want[j], j == o))
            out[key] = j
            want[j] -= s
            load[j] += s
    size = dict(units)
    held = defaultdict(list)
    for key, j in out.items():
        held[j].append(key)
    excess = [a - c for a, c in zip(load, capacity)]
    for _ in range(4 * len(units)):  # move the unit that best halves the largest difference
        hi, lo = max(range(len(excess)), key=excess.__getitem__), min(range(len(excess)), key=excess.__getitem__)
        gap = excess[hi] - excess[lo]
        key = min(held[hi], key=lambda u: (abs(2 * size[u] - gap), u), default=None)
        if key is None or not 0 < size[key] < gap:
            break
        held[hi].remove(key)
        held[lo].append(key)
        out[key] = lo
        excess[hi] -= size[key]
        excess[lo] += size[key]
    return out


def _plan(spark: SparkSession, base: DataFrame, shards: int, capacities: list[int] | None) -> DataFrame:
    """(old, block, pieces, cells, to: new shard of each piece) for every block: at most
    ``BLOCKS`` rows per old shard, so it is broadcast."""
    stats = base.groupBy("old", "block").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).collect()
    total = sum(r.bytes for r in stats)
    capacity = capacities or even_capacities(total, shards)
    if sum(capacity) < total:
        raise ValueError("the new shards cannot hold the old ones")
    most = max(1, int(SPLIT_SHARE * min(capacity)))
    pieces = {(r.old, r.block): max(1, min(r.rows, -(-r.bytes // most))) for r in stats}
    hot = [(o, b, n) for (o, b), n in pieces.items() if n > 1]
    units = [((r.old, r.block, 0), r.bytes) for r in stats if pieces[r.old, r.block] == 1]
    if hot:
        cut = F.broadcast(spark.createDataFrame(hot, "old int, block int, pieces int"))
        got = (base.join(cut, ["old", "block"]).groupBy("old", "block", F.pmod("spread", "pieces").cast("int").alias("piece"))
               .agg(F.sum("size").alias("bytes")).collect())   # 1 / SPLIT_SHARE rows per shard, about
        units += [((r.old, r.block, r.piece), r.bytes) for r in got]
    to = deal_blocks(units, capacity)
    rows = [(r.old, r.block, pieces[r.old, r.block],
             max(1, -(-r.rows // CELL_ROWS), -(-r.bytes // CELL_BYTES)),
             [to.get((r.old, r.block, p), 0) for p in range(pieces[r.old, r.block])]) for r in stats]
    return spark.createDataFrame(rows, "old int, block int, pieces int, cells int, to array<int>")


def reshard(docs: DataFrame, old_shard: Column, shards: int = 8, capacities: list[int] | None = None,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` into the new shards (one folder per shard below the shared checkpoint
    folder) and return what was written: all columns, and size (UTF-8 bytes of the text plus
    1), shard, slot (0, 1, 2... within the shard) and moved (the shard is not the old one).

    Sizes come as near the capacities (equal, unless given) as blocks allow.  Equal texts
    share a shard unless they weigh more than ``SPLIT_SHARE`` of one.  A null text has size
    1; null ids and repeated rows are placed like others; columns with the names of added
    ones are kept, and the added ones get the next free name.  No rows give an empty frame.
    """
    spark = docs.sparkSession
    add = {c: free_name(docs, c) for c in ("size", "shard", "slot", "moved")}
    tmp = {c: free_name(docs, f"reshard_{c}") for c in ("old", "block", "spread", "pieces", "cells", "to", "cell", "row")}
    text = F.xxhash64(F.col(text_col))
    marked = docs.select(
        "*", (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias(add["size"]),
        old_shard.cast("int").alias(tmp["old"]),
        F.pmod(F.shiftright(text, 20), F.lit(BLOCKS)).cast("int").alias(tmp["block"]),
        F.xxhash64(F.col(id_col), F.lit(5)).alias(tmp["spread"]))
    base = marked.select(F.col(tmp["old"]).alias("old"), F.col(tmp["block"]).alias("block"),
                         F.col(tmp["spread"]).alias("spread"), F.col(add["size"]).alias("size"))
    plan = _plan(spark, base, shards, capacities).withColumnsRenamed({c: tmp[c] for c in ("old", "block", "pieces", "cells", "to")})
    piece = F.pmod(F.col(tmp["spread"]), F.col(tmp["pieces"]))
    placed = (marked.join(F.broadcast(plan), [tmp["old"], tmp["block"]])
              .withColumn(add["shard"], F.element_at(tmp["to"], (piece + 1).cast("int")))
              .withColumn(tmp["cell"], F.concat_ws(":", tmp["old"], tmp["block"], piece,
                                                   F.pmod(F.shiftright(F.col(tmp["spread"]), 8), F.col(tmp["cells"]))))
              .withColumn(add["moved"], F.col(add["shard"]) != F.col(tmp["old"])))
    order = Window.partitionBy(add["shard"], tmp["cell"]).orderBy(id_col, F.xxhash64(F.col(text_col)))
    path = shared_path(spark, "shards")
    out = placed.withColumn(tmp["row"], F.row_number().over(order)).select(
        *docs.columns, add["size"], add["moved"], tmp["cell"], tmp["row"], add["shard"])
    out.write.partitionBy(add["shard"]).parquet(path)
    files = spark.read.schema(out.schema).parquet(path)
    count = files.groupBy(add["shard"], tmp["cell"]).agg(F.max(tmp["row"]).alias("n"))
    before = Window.partitionBy(add["shard"]).orderBy(tmp["cell"]).rowsBetween(Window.unboundedPreceding, -1)
    first = count.select(add["shard"], tmp["cell"], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    slot = free_name(files, "first")
    return (files.join(first.withColumnRenamed("first", slot), [add["shard"], tmp["cell"]])
            .withColumn(add["slot"], (F.col(slot) + F.col(tmp["row"]) - 1).cast("long"))
            .select(*docs.columns, add["size"], add["shard"], add["slot"], add["moved"]))
