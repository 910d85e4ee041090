"""Near-duplicate documents: SuperMinHash signatures, banding, verification, grouping.

* Signature.  Every shingle draws its ranks for the positions of the signature from one
  pseudorandom permutation, level by level: at level j it offers ``j + u`` (u uniform in
  [0, 1)) to the j-th position of its permutation.  Ranks of one shingle are thus never
  equal, which lowers the variance against independent MinHash.  A text stops as soon as
  all its positions are filled: later levels only offer larger values.
* Texts with equal shingle sets are one class; only classes go on.
* Banding.  Classes that agree on ``rows`` neighbouring positions share a bucket.  With the
  defaults (24 bands of 4) a pair at similarity 0.8 is missed with probability 3e-6, and
  pairs that share no bucket are still compared if buckets connect them (below).
* Verification.  Buckets propose one edge per member, to the bucket's leader; the connected
  components of these proposals are clusters.  Within a cluster all links between different
  texts are decided on full shingle sets: small clusters in one task; in large ones each
  member is first compared with one leader, what that does not connect to the main component
  with the leaders of its other buckets, and what is still loose with all members, block by
  block.  Pairs that are connected already
  are not compared, and tasks return spanning edges (small clusters: roots) only, never all
  pairs.  In large clusters each step passes on links between parts, not between classes, so
  that the next search for components starts from what is known.

Shingles, sets and classes are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.session import ship_package

from . import words as W
from .components import components
from .stage import free_name, written

BANDS, ROWS = 24, 4
#: A cluster of at most so many classes and shingles is decided in one task.
TILE_MEMBERS, TILE_SHINGLES = 128, 2_000_000
#: Classes per block in larger clusters (with ``TILE_SHINGLES`` shingles at most, about).
BLOCK_MEMBERS = 1024


def superminhash(elem: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs x m, uint64: level in the high 24 bits, u in the low 40) of the
    sets given as (doc, element hash); a set without elements keeps the largest value."""
    sig = np.full((n_docs, m), np.iinfo(np.uint64).max, np.uint64)
    flat = sig.reshape(-1)
    perm = np.tile(np.arange(m, dtype=np.uint16), (len(elem), 1))
    for level in range(m):
        if not len(elem):
            break
        at = np.arange(len(elem))
        r = W.mix(elem + np.uint64((level + 1) * W._GOLDEN & (2**64 - 1)))
        k = level + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - level)) >> np.uint64(32)).astype(np.int64)
        place = perm[at, k]
        perm[at, k] = perm[:, level]
        np.minimum.at(flat, doc.astype(np.int64) * m + place, np.uint64(level << 40) | (r >> np.uint64(24)))
        open_ = (sig.max(axis=1) >= np.uint64((level + 1) << 40))[doc]
        if not open_.all():
            elem, doc, perm = elem[open_], doc[open_], perm[open_]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n_docs x bands keys; the band's number is part of its key."""
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for i in range(rows):
            h = W.mix(h * np.uint64(W._BASE) + sig[:, b * rows + i])
        out[:, b] = h
    return out


def _signer(text: str, k: int, bands: int, rows: int):
    """Adds to each row: set size, class key, band keys.  The text itself is not passed on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, text):
                n = part.num_rows
                doc, h = W.shingle_sets(*W.words(part.column(text)), n, k)
                size = np.bincount(doc, minlength=n)
                one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(one, doc, W.mix(h + np.uint64(1)))
                np.add.at(two, doc, W.mix(h + np.uint64(2)))
                key = W.mix(W.mix(one) + two + size.astype(np.uint64))
                keys = band_keys(superminhash(h, doc, n, bands * rows), bands, rows)
                ends = pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32))
                cols = [part.column(i) for i, c in enumerate(part.schema.names) if c != text]
                names = [c for c in part.schema.names if c != text]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(size.astype(np.int64)), pa.array(key.view(np.int64)),
                     pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1).view(np.int64)))],
                    [*names, "n", "class", "bands"])
    return run


def _set_maker(text: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, text):
                doc, h = W.shingle_sets(*W.words(part.column(text)), part.num_rows, k)
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=part.num_rows)))).astype(np.int32)
                cols = [part.column(i) for i, c in enumerate(part.schema.names) if c != text]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))],
                    [*(c for c in part.schema.names if c != text), "shingles"])
    return run


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``left``, the sets of ``right`` at or above the similarity."""
    sizes = np.array([len(x) for x in right], np.int64)
    values = np.concatenate(right) if right else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for i, x in enumerate(left):
        lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
        n = hi - lo
        hit = n > 0
        lo, n = lo[hit], n[hit]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else lo, n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(right))
        yield i, np.flatnonzero((100 * common >= percent * (len(x) + sizes - common)) & (common > 0))


def _spanning(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> tuple[pd.DataFrame, dict[int, int]]:
    """Edges that connect the parts linked between the two blocks, and the root of each part in
    an edge; frames hold part (what is known to be connected already) and shingles."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    a, b = [], []
    lp, rp = left["part"].tolist(), right["part"].tolist()
    for i, hits in _linked(list(left["shingles"]), list(right["shingles"]), percent):
        for j in hits.tolist():
            x, y = find(lp[i]), find(rp[j])
            if x != y:
                parent[x] = y
                a.append(lp[i])
                b.append(rp[j])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)}), {x: find(x) for x in list(parent)}


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: id, text_hash (xxhash64 of the text), n_shingles,
    component_id (smallest id reachable over links) and kept (the row has that id).

    Words are runs of non-space characters with A-Z lower-cased; a set holds the distinct
    ``k``-word shingles, or the whole sequence of a shorter text.  Texts link at
    ``100 * intersection >= percent * union``.  A null or empty text, or one of white space
    only, has no set, links with nothing and is its own component.  A null id takes part
    with its text, is never the smallest unless its component has no other id, and is kept
    only then.  Repeated ids and rows stay as they are.  Other columns are not read.  An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    narrow = base.select("id", F.xxhash64("text").alias("text_hash"), "text")
    signed = written(narrow.mapInArrow(
        _signer("text", k, bands, rows),
        "id long, text_hash long, n long, class long, bands array<long>"), "signed")
    full = signed.filter("n > 0")
    classes = written(full.groupBy("class").agg(
        F.min("id").alias("low"), F.first("n").alias("n"), F.first("bands").alias("bands"),
        F.min("text_hash").alias("text_hash")), "classes")

    # buckets of two or more classes, and the leader each proposes
    spread = classes.select("class", F.explode("bands").alias("band"))
    leader = (spread.groupBy("band").agg(F.count("*").alias("members"), F.min(F.struct(
        F.xxhash64("class").alias("p"), F.col("class").alias("id"))).alias("lead"))
        .filter("members > 1").select("band", F.col("lead.id").alias("leader")))
    proposed = written(spread.join(leader, "band").filter("class != leader")
                       .groupBy("class", "leader").count(), "proposed", narrow=True)
    cluster = components(proposed.select(F.col("class").alias("a"), F.col("leader").alias("b")))
    cluster = cluster.withColumnsRenamed({"node": "class", "root": "cluster"})

    # the sets of clustered classes only, from one text of each class
    wanted = written(cluster.join(classes.select("class", "n", "text_hash"), "class"), "wanted")
    texts = (narrow.filter("text is not null").join(F.broadcast(wanted.select("text_hash")) if _small(wanted)
                                                    else wanted.select("text_hash"), "text_hash", "left_semi"))
    one = texts.groupBy("text_hash").agg(F.first("text").alias("text"))
    sets = one.mapInArrow(_set_maker("text", k), "text_hash long, shingles array<long>")
    members = written(wanted.join(sets, "text_hash").drop("text_hash"), "members")

    size = members.groupBy("cluster").agg(F.count("*").alias("in_cluster"), F.sum("n").alias("weight"))
    small = (F.col("in_cluster") <= TILE_MEMBERS) & (F.col("weight") <= TILE_SHINGLES)
    wide = written(size.filter(~small), "wide", narrow=True)

    def decide(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(part=frame["class"])
        _, roots = _spanning(frame, frame, percent)
        return pd.DataFrame({"class": frame["class"], "root": [roots.get(c, c) for c in frame["class"].tolist()]})

    tight = members.join(_hint(wide.select("cluster")), "cluster", "left_anti")
    linked = tight.groupBy("cluster").applyInPandas(decide, "class long, root long")
    if not wide.isEmpty():
        linked = linked.unionByName(_wide_roots(members, wide, proposed, percent))
    linked = written(linked, "linked")

    lows = (classes.select("class", "low").join(linked, "class", "left")
            .withColumn("root", F.coalesce("root", "class")))
    least = lows.groupBy("root").agg(F.min("low").alias("component_id"))
    final = lows.join(least, "root").select("class", "component_id")
    out = (full.join(final, "class").select("id", "text_hash", F.col("n").alias("n_shingles"), "component_id")
           .unionByName(signed.filter("n = 0").select("id", "text_hash", F.col("n").alias("n_shingles"),
                                                      F.col("id").alias("component_id"))))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


#: Rows of one long below which a table is broadcast (8 bytes each, before overhead).
BROADCAST_ROWS = 500_000


def _small(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def _hint(df: DataFrame) -> DataFrame:
    """A written table of few columns, broadcast if its rows are few: the other side, in which
    one cluster may hold a third of the rows, is then not dealt out by cluster."""
    return F.broadcast(df) if _small(df) else df


def _wide_roots(members: DataFrame, wide: DataFrame, proposed: DataFrame, percent: int) -> DataFrame:
    """(class, root) of the classes in clusters too large for one task."""
    inside = written(members.join(_hint(wide), "cluster").withColumnRenamed("weight", "cluster_weight"), "inside")
    sets = inside.select("class", "n", "shingles")

    def verified(pairs: DataFrame) -> DataFrame:
        pair = (pairs.join(sets, "class")
                .join(sets.withColumnsRenamed({"class": "leader", "n": "m", "shingles": "others"}), "leader")
                .withColumn("common", F.size(F.array_intersect("shingles", "others"))))
        return (pair.filter(100 * F.col("common") >= percent * (F.col("n") + F.col("m") - F.col("common")))
                .select(F.col("class").alias("a"), F.col("leader").alias("b")))

    def merged(part: DataFrame, edges: DataFrame) -> DataFrame:
        """(cluster, class, n, part) by further edges between parts."""
        root = components(edges).withColumnRenamed("node", "part")
        return written(part.join(root, "part", "left").select("cluster", "class", "n", F.coalesce("root", "part").alias("part")),
                       "parts", narrow=True)

    def marked(part: DataFrame) -> DataFrame:
        """The rows of ``part`` with loose: theirs is not the largest part of their cluster."""
        largest = (part.groupBy("cluster", "part").count().groupBy("cluster")
                   .agg(F.max(F.struct("count", "part")).alias("m"))
                   .select("cluster", F.col("m.part").alias("main")))
        main = written(largest, "main", narrow=True)
        return part.join(_hint(main), "cluster").withColumn("loose", F.col("part") != F.col("main")).drop("main")

    best = (proposed.groupBy("class").agg(F.max(F.struct("count", "leader")).alias("m"))
            .select("class", F.col("m.leader").alias("leader")))
    part = merged(inside.select("cluster", "class", "n", F.col("class").alias("part")), verified(best))
    loose = marked(part).filter("loose").select("class")
    more = verified(proposed.select("class", "leader").join(loose, "class")
                    .join(best, ["class", "leader"], "left_anti"))
    name = part.select("class", "part")
    part = merged(part, more.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b")
                  .select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a != b"))
    marks = marked(part)
    rest = written(marks.filter("loose").groupBy("cluster")
                   .agg(F.count("*").alias("in_loose"), F.sum("n").alias("loose_weight")), "rest", narrow=True)
    if rest.isEmpty():
        return part.select("class", F.col("part").alias("root"))

    def blocks(count: str, weight: str):
        return F.greatest(F.lit(1), F.ceil(F.col(count) / BLOCK_MEMBERS),
                          F.ceil(F.col(weight) / TILE_SHINGLES)).cast("int")

    plan = written(inside.join(_hint(rest), "cluster").join(marks.select("class", "part", "loose"), "class")
                   .withColumn("all_blocks", blocks("in_cluster", "cluster_weight"))
                   .withColumn("loose_blocks", blocks("in_loose", "loose_weight"))
                   .withColumn("h", F.xxhash64("class", F.lit(7))), "plan")
    cols = ["cluster", "part", "shingles"]
    every = plan.select(*cols, F.expr("pmod(h, all_blocks)").cast("int").alias("x"),
                        F.explode(F.sequence(F.lit(0), F.col("loose_blocks") - 1)).alias("y"))
    loose = plan.filter("loose").select(
        *cols, F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("x"),
        F.expr("pmod(h, loose_blocks)").cast("int").alias("y"))

    def compare(both: pd.DataFrame) -> pd.DataFrame:
        return _spanning(both[both["loose"]], both[~both["loose"]], percent)[0]

    both = loose.withColumn("loose", F.lit(True)).unionByName(every.withColumn("loose", F.lit(False)))
    part = merged(part, both.groupBy("cluster", "x", "y").applyInPandas(compare, "a long, b long"))
    return part.select("class", F.col("part").alias("root"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all columns as they were.

    Rows without words are no copies of one another and all stay, but for repeated rows
    (equal id and text), of which one stays.
    """
    key = free_name(docs, "text_hash")
    gone = near_duplicates(docs, id_col, text_col, **params).filter("not kept").select(
        F.col("id").alias("_i"), F.col("text_hash").alias("_h")).distinct()
    marked = docs.withColumn(key, F.xxhash64(F.col(text_col)))
    left = marked.join(gone, marked[id_col].cast("long").eqNullSafe(F.col("_i")) & (marked[key] == F.col("_h")),
                       "left_anti")
    return left.dropDuplicates([id_col, key]).select(*docs.columns)
