"""Mixing sources to target weights by fixed-length blocks.

Each source's words, its documents laid end to end in a pseudorandom order, are packed into
blocks of ``BLOCK`` words.  A source's target is filled by slots: whole passes over its
blocks, then part of one; the last slot is cut to the word.  Per output shard the number of
slots of each source is a multinomial draw over what the sources still have to give.  A
slot's block is its number mapped through the source's own pseudorandom permutation of the
pass, and blocks are joined by index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featurelab.session import ship_package

from . import words as W
from .stage import free_name, written

BLOCK, SHARDS = 512, 64
SHARE, REPEATS = Fraction(3, 2), 2
WEIGHTS = (3, 1, 2)
#: Sources that the driver plans for; a table with more is refused.
MAX_SOURCES = 1_000_000
ALIKE_PARTS = 256                    # parts in which rows of equal id, source and text are numbered
CELL_ROWS = 10_000                   # documents of a source whose positions one task adds up


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, most: int = REPEATS) -> list[Fraction]:
    """Words to take of each source: ``share`` of all, dealt by weight; a target stops at
    ``most`` times its source, and what is over is dealt again by weight."""
    out = [Fraction(most * s) for s in sizes]
    rest, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        full = {i for i in open_ if rest * weights[i] > most * sizes[i] * weight}
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / weight
            break
        rest -= sum(most * sizes[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Pseudorandom permutation of [0, n): a four-round Feistel network on the next even
    number of bits, walked until the value falls below n.  All arguments elementwise."""
    x, n, key = (np.asarray(v, np.uint64).copy() for v in (x, n, key))
    half = np.ones(len(n), np.uint64)
    while (low := (np.uint64(1) << (half * np.uint64(2))) < n).any():
        half[low] += np.uint64(1)
    todo = np.arange(len(x))
    while len(todo):
        h, m = half[todo], (np.uint64(1) << half[todo]) - np.uint64(1)
        left, right = x[todo] >> h, x[todo] & m
        for r in (range(3, -1, -1) if inverse else range(4)):
            if inverse:
                left, right = right ^ (W.mix(left + key[todo] + np.uint64(r * 0x9E3779B97F4A7C15 & (2**64 - 1))) & m), left
            else:
                left, right = right, left ^ (W.mix(right + key[todo] + np.uint64(r * 0x9E3779B97F4A7C15 & (2**64 - 1))) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


class Plan:
    """What the driver knows of each source; arrays by source number."""

    def __init__(self, sources: list, seed: int):
        order = sorted(sources, key=lambda r: (r.source is None, r.source or ""))     # by code point, null last
        self.names = [r.source for r in order]
        self.sizes = [int(r.words) for r in order]
        self.targets = targets(self.sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(order))])
        self.keys = np.array([int.from_bytes(hashlib.sha256(repr((seed, s)).encode()).digest()[:8], "big") >> 1
                              for s in self.names], np.uint64)
        self.blocks = np.array([-(-s // BLOCK) for s in self.sizes], np.int64)
        slots, cut = [], []
        for i, t in enumerate(self.targets):
            n, words = int(self.blocks[i]), int(t)
            passes, rest = divmod(words, self.sizes[i]) if self.sizes[i] else (0, 0)
            short = self.sizes[i] - (n - 1) * BLOCK          # words of the source's last block
            used = -(-rest // BLOCK)
            last = rest - (used - 1) * BLOCK if rest else BLOCK
            if rest:
                at = int(permute([n - 1], [n], [self.key(i, passes)], inverse=True)[0])
                if rest > at * BLOCK:                        # the short block comes before the end
                    if rest <= at * BLOCK + short:
                        used, last = at + 1, rest - at * BLOCK
                    else:
                        used = 1 + -(-(rest - short) // BLOCK)
                        last = rest - short - (used - 2) * BLOCK
            slots.append(passes * n + used)
            cut.append(last)
        self.slots, self.cut = np.array(slots, np.int64), np.array(cut, np.int64)
        self.ends = np.cumsum(self.slots)
        self.draws = self._draws(seed)

    def key(self, source: int, epoch: int) -> int:
        return int(self.keys[source]) + epoch

    def _draws(self, seed: int) -> np.ndarray:
        """Slots up to and including each shard, by source: multinomial draws over what is left."""
        rng = np.random.default_rng(seed)
        left, out = self.slots.copy(), []
        for s in range(SHARDS):
            want = int(left.sum()) // (SHARDS - s)
            got = np.zeros(len(left), np.int64)
            while (need := want - int(got.sum())) > 0:       # draws beyond what a source has are drawn again
                room = left - got
                got += np.minimum(rng.multinomial(need, room / room.sum()), room)
            left = left - got
            out.append(got)
        return np.cumsum(np.array(out).reshape(SHARDS, -1), axis=0)


def _slots(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = batch.column(0).to_numpy()
            src = np.searchsorted(plan.ends, g, "right")
            j = g - (plan.ends - plan.slots)[src]
            n = plan.blocks[src]
            epoch = j // n
            shard = np.zeros(len(g), np.int64)
            for s in np.unique(src):
                at = src == s
                shard[at] = np.searchsorted(plan.draws[:, s], j[at], "right")
            index = permute(j % n, n, plan.keys[src] + epoch.astype(np.uint64))
            take = np.where(j == plan.slots[src] - 1, plan.cut[src], BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (shard, j, src, epoch, index, take)],
                                             ["shard", "slot", "source_no", "epoch", "block", "take"])
    return run


def _counted(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = W.buffers(batch.column(text))
            size = np.zeros(batch.num_rows, np.int64)
            for lo, hi in W._segments(off, data, W.SPACES):
                inside = ~W.SPACES[data[lo:hi]]
                first = inside.copy()
                first[1:] &= ~inside[:-1]
                cut = off[(off > lo) & (off < hi)] - lo
                first[cut] = inside[cut]
                row = np.searchsorted(off, np.flatnonzero(first) + lo, "right") - 1
                size += np.bincount(row, minlength=batch.num_rows)
            cols = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != text]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(size)], [*(c for c in batch.schema.names if c != text), "size"])
    return run


class Mix:
    """A planned mix over ``rows`` (row, doc_id, source, size, place: written, one per document row).
    Documents are ordered by doc_id and ``place`` in a keyed random order.

    ``segments``: (row, source_no, block, lo, off, len): which words of a document lie in
    which block.  ``slots``: (shard, slot, source_no, epoch, block, take).  ``pieces``: the
    two joined by block: (row, shard, slot, epoch, lo, taken)."""

    def __init__(self, rows: DataFrame, seed: int = 0):
        spark = rows.sparkSession
        self.rows = rows
        sources = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        found = sources.limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        self.plan = plan = Plan(found, seed)
        docs = {r.source: r.docs for r in found}
        table = [(name, i, -(-docs[name] // CELL_ROWS), plan.sizes[i], float(plan.targets[i]))
                 for i, name in enumerate(plan.names)]
        self.sources = spark.createDataFrame(
            table, "name string, source_no long, cells long, source_size long, target double")
        known = rows.join(self.sources, F.col("source").eqNullSafe(F.col("name"))).drop("name")
        # a document's place in its source: cells first, then documents within a cell
        dealt = known.withColumn("h", F.xxhash64("doc_id", "place", F.lit(seed))).withColumn("cell", F.pmod("h", "cells"))
        cells = dealt.groupBy("source_no", "cell").agg(F.sum("size").alias("words"))
        over = Window.partitionBy("source_no").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        begin = cells.select("source_no", "cell", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("begin"))
        within = Window.partitionBy("source_no", "cell").orderBy("h", "place", "row").rowsBetween(Window.unboundedPreceding, -1)
        self.placed = (dealt.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
                       .join(begin, ["source_no", "cell"])
                       .select("row", "doc_id", "source_no", "size", "source_size", "target",
                               (F.col("begin") + F.col("before")).alias("start")))
        first, last = F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}")
        self.segments = (self.placed.filter("size > 0")
                         .select("row", "source_no", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
                         .withColumn("lo", F.greatest(F.lit(0), F.col("block") * BLOCK - F.col("start")))
                         .withColumn("off", F.greatest(F.lit(0), F.col("start") - F.col("block") * BLOCK))
                         .withColumn("len", F.least(F.col("size") - F.col("lo"), BLOCK - F.col("off")))
                         .select("row", "source_no", "block", "lo", "off", "len"))
        n = int(plan.slots.sum())
        self.slots = spark.range(n).mapInArrow(
            _slots(plan), "shard long, slot long, source_no long, epoch long, block long, take long")
        self.pieces = (self.segments.join(self.slots, ["source_no", "block"])
                       .withColumn("taken", F.least("len", F.col("take") - F.col("off"))).filter("taken > 0")
                       .select("row", "shard", "slot", "epoch", "lo", "taken"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, doc_id, source, size, place): number of words of each row, written.

    ``place`` hashes the text and, of rows alike in id, source and text, the number of the
    row: it does not depend on how the input is partitioned.  ``row`` only joins."""
    ship_package(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                      F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    sizes = src.mapInArrow(_counted("text"), "doc_id long, source string, hash long, size long")
    alike = sizes.groupBy("doc_id", "source", "hash", "size").agg(F.count("*").alias("n"))
    each = alike.select("doc_id", "source", "size", "hash", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("turn"))
    return written(each.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "size",
                               F.xxhash64("hash", "turn").alias("place")), "sizes")


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``turn``: numbers from 1 for rows alike in doc_id, source and hash.  Which
    row gets which number is open, the numbers are not.  Alike rows are numbered in
    ``ALIKE_PARTS`` parts, whose counts give the offsets, so that no task sorts all of them."""
    alike, part = ["doc_id", "source", "hash"], F.pmod(F.xxhash64("row"), F.lit(ALIKE_PARTS))
    parts = rows.withColumn("part", part)
    before = Window.partitionBy(*alike).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parts.groupBy(*alike, "part").agg(F.count("*").alias("n"))
               .select(*(F.col(c).alias(f"_{c}") for c in (*alike, "part")),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    within = F.row_number().over(Window.partitionBy(*alike, "part").orderBy("row"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in alike] + [F.col("part") == F.col("_part")]
    return (parts.withColumn("within", within).join(offsets, same)
            .select(*rows.columns, (F.col("offset") + F.col("within")).alias("turn")))


def mix_words(docs: DataFrame, seed: int = 0, **columns) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``: how many of its
    words the mix takes, repeats counted.

    Words are runs of characters other than ASCII white space; a null or empty text has
    none and nothing is taken of it.  The weights 3, 1, 2 go to the sources in order of
    their names, null last.  Repeated rows are packed one by one.  A row is taken at most
    twice.  Further columns are not read; no rows give no rows.
    """
    m = Mix(measured(docs, **columns), seed)
    taken = m.pieces.groupBy("row").agg(F.sum("taken").alias("taken"))
    return (m.placed.join(taken, "row", "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mix_documents(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The mix as rows with the columns of ``docs``: each pass over a document gives one row
    for each run of its words that the mix takes (the whole text where all are taken).  The
    text is that part of the document, unchanged; ``chars_col``, if there, is its length.

    Documents are placed as in ``mix_words``, however the input is partitioned.  Of rows alike
    in id, source and text but not in further columns, any may take the place of another.
    Null and empty texts give no row; no rows give none."""
    key = free_name(docs, "mix_row")
    kept = written(docs.withColumn(key, F.monotonically_increasing_id()), "mix-docs")
    ship_package(docs.sparkSession)
    counted = written(kept.select(F.col(key).alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                                  F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("hash"),
                                  F.col(text_col).alias("text"))
                      .mapInArrow(_counted("text"), "row long, doc_id long, source string, hash long, size long"), "counted")
    sizes = written(_numbered(counted).select("row", "doc_id", "source", "size", F.xxhash64("hash", "turn").alias("place")), "sizes")
    runs = (Mix(sizes, seed).pieces.groupBy("row")
            .agg(F.sort_array(F.collect_list(F.struct("epoch", "lo", "taken"))).alias("runs")))
    parts = free_name(docs, "runs")
    joined = (kept.join(runs.withColumnsRenamed({"row": key, "runs": parts}), key)
              .select(*docs.columns, parts))
    names = joined.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, text_col):
                row, _, first, end = W.words(part.column(text_col), spans=True)
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                take, texts = [], []
                for i, runs_ in enumerate(part.column(parts).to_pylist()):
                    raw = part.column(text_col)[i].as_py()
                    data, n = raw.encode(), int(at[i + 1] - at[i])
                    for lo, hi in _merged(runs_):
                        take.append(i)
                        texts.append(raw if hi - lo == n else data[first[at[i] + lo]:end[at[i] + hi - 1]].decode())
                out = part.take(pa.array(take, pa.int64()))
                cols = [pa.array(texts, pa.string()) if c == text_col else
                        pa.array([len(t) for t in texts], pa.int64()).cast(out.column(c).type) if c == chars_col
                        else out.column(c) for c in names if c != parts]
                yield pa.RecordBatch.from_arrays(cols, [c for c in names if c != parts])

    return joined.mapInArrow(cut, joined.drop(parts).schema)


def _merged(runs: list[dict]) -> Iterator[tuple[int, int]]:
    """Runs of words [lo, hi) that follow one another in the same pass become one."""
    last = None
    for r in runs:
        lo, hi = r["lo"], r["lo"] + r["taken"]
        if last and last[0] == r["epoch"] and last[2] == lo:
            last[2] = hi
        else:
            if last:
                yield last[1], last[2]
            last = [r["epoch"], lo, hi]
    if last:
        yield last[1], last[2]
