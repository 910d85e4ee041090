"""Exact deduplication by counting quotient filters, with byte verification.

1. One pass over the texts writes a light table: id, length, 64-bit fingerprint and SHA-256
   of each normalised text.
2. Each partition counts its fingerprints in counting quotient filters, cut into slices of
   the fingerprint range; the filters of a slice are merged without loss.
3. Fingerprints counted more than once set a bit in a bitmap of fixed largest size.  Rows
   whose bit is not set are unique: they are done without another look at their text.
4. The others are read again, and the distinct texts behind each (fingerprint, SHA-256) are
   compared byte by byte, as grouping keys.  Different texts with the same pair, should they
   ever occur, are told apart by number.
5. Classes are counted on the light table; rows join them back, those of large classes over
   several tasks.

A full bitmap (from some tens of millions of repeated fingerprints on) only sends more rows
to step 4; results do not change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featurelab.session import ship_package

from . import quotient_filter as Q
from .hot import join_classes
from .stage import free_name, written

#: Fingerprints held at once per task, and wanted per slice.
BUFFER, SLICE = 1 << 20, 1 << 20
LEAST_SLICE_BITS = 6
MOST_BITMAP_BITS = 26                # 8 MB: at most 2**20 words of 64 bits are broadcast
WHITE_SPACE = "\t\n\x0b\x0c\r "


def normalised(text: Column) -> Column:
    """The text without its ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _count_filters(slice_bits: int):
    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        f, c = Q.tally(np.concatenate(held))
        part = (f >> np.uint64(64 - slice_bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        ends = [*first[1:].tolist(), len(f)]
        made = [Q.encode(f[a:b], c[a:b], slice_bits) for a, b in zip(first.tolist(), ends)]
        yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(made, pa.binary())], ["slice", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column("f").to_numpy().view(np.uint64))
            n += batch.num_rows
            if n >= BUFFER:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)
    return run


def _repeated(bitmap_bits: int):
    """Words of the bitmap with the bits of fingerprints that the merged filter counts twice or more."""
    def run(group: pa.Table) -> pa.Table:
        f, c = Q.merge(group.column("filter").to_pylist())
        at = f[c > 1] >> np.uint64(64 - bitmap_bits)
        words, first = np.unique(at >> np.uint64(6), return_index=True)
        bits = np.uint64(1) << (at & np.uint64(63))
        ored = np.bitwise_or.reduceat(bits, first) if len(first) else bits
        return pa.table({"word": pa.array(words.astype(np.int64)), "bits": pa.array(ored.view(np.int64))})
    return run


def _light(docs: DataFrame, id_col: str, text_col: str, fingerprint: Callable[[Column], Column],
           digest: Callable[[Column], Column]) -> DataFrame:
    text = F.col(text_col)
    return (docs.select(F.col(id_col).alias("id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"),
                        normalised(text).alias("norm"))
            .select("id", "chars", "norm", fingerprint(F.col("norm")).cast("long").alias("f"), digest(F.col("norm")).alias("digest")))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           fingerprint: Callable[[Column], Column] = F.xxhash64,
           digest: Callable[[Column], Column] = lambda c: F.sha2(c, 256)) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, n_chars), one row for each row of ``docs``.

    Texts are equal when they agree without ASCII white space; null counts as empty.  Of
    equal texts the row with the most code points stays, then the one with the smallest id
    (a null id comes last); of rows alike in both, one.  ``keep_id`` is the id of the row
    that stays.  Very long texts are whole grouping keys, one copy of each per task.  An
    empty table gives no rows; other columns are not read, whatever their names.
    ``fingerprint`` and ``digest`` may collide: results then only cost more.
    """
    ship_package(docs.sparkSession)
    texts = _light(docs, id_col, text_col, fingerprint, digest)
    light = written(texts.drop("norm").withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    n = light.count()
    slice_bits = max(LEAST_SLICE_BITS, (n // SLICE).bit_length())
    bitmap_bits = min(MOST_BITMAP_BITS, max(10, (16 * n).bit_length()))
    bitmap = written(light.select("f").mapInArrow(_count_filters(slice_bits), "slice long, filter binary")
                     .groupBy("slice").applyInArrow(_repeated(bitmap_bits), "word long, bits long")
                     .groupBy("word").agg(F.bit_or("bits").alias("bits")), "repeated")

    def routed(df: DataFrame) -> DataFrame:
        at = F.shiftrightunsigned("f", 64 - bitmap_bits)
        hit = df.withColumn("word", F.shiftright(at, 6)).join(F.broadcast(bitmap), "word", "left")
        bit = F.getbit(F.coalesce("bits", F.lit(0).cast("long")), F.pmod(at, F.lit(64)).cast("int"))
        return hit.withColumn("routed", bit == 1).drop("word", "bits")

    again = routed(texts).filter("routed").select("f", "digest", "norm").distinct()
    clashes = written(again.groupBy("f", "digest").agg(F.count("*").alias("texts")).filter("texts > 1"), "clashes")
    keys = ["f", "digest"]
    marked = routed(light)
    if not clashes.isEmpty():
        # different texts behind one pair: light is made again with the number of each row's text
        numbered = written(again.join(clashes, keys, "left_semi").withColumn(
            "variant", F.row_number().over(Window.partitionBy(*keys).orderBy("norm"))), "variants")
        marked = written(routed(texts).withColumn("row", F.monotonically_increasing_id())
                         .join(numbered, [*keys, "norm"], "left")
                         .withColumn("variant", F.coalesce("variant", F.lit(0))).drop("norm"), "told-apart")
        keys = [*keys, "variant"]
    first = F.max(F.struct("chars", F.bitwise_not(F.col("id").cast("long")).alias("late"), (-F.col("row")).alias("turn")))
    classes = written(marked.filter("routed").groupBy(*keys).agg(F.count("*").alias("group_size"), first.alias("first")), "classes")
    grouped = join_classes(marked.filter("routed"), classes, keys, "group_size", n, F.col("row"))
    out = grouped.select("id", F.bitwise_not(F.col("first.late")).alias("keep_id"), "group_size",
                         (F.col("row") == -F.col("first.turn")).alias("kept"), "digest", "chars")
    single = marked.filter("not routed").select("id", F.col("id").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                                F.lit(True).alias("kept"), "digest", "chars")
    return single.unionByName(out).withColumnsRenamed({"id": "doc_id", "chars": "n_chars"})


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; see ``copies``.  Of rows alike in
    id, length and normalised text any one stays whole."""
    keep = copies(docs, id_col, text_col).filter("kept").select("doc_id", "n_chars", "digest").distinct()
    i, c, d = (free_name(docs, x) for x in ("copy_id", "copy_chars", "copy_digest"))
    text = F.col(text_col)
    rows = docs.withColumns({i: F.coalesce(F.col(id_col).cast("string"), F.lit("")), c: F.coalesce(F.length(text), F.lit(0)).cast("long"),
                             d: F.sha2(normalised(text), 256)})
    keep = keep.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(i), F.col("n_chars").alias(c), F.col("digest").alias(d))
    return rows.join(keep, [i, c, d], "left_semi").dropDuplicates([i, c, d]).drop(i, c, d)
