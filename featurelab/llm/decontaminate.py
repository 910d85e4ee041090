"""Benchmark decontamination: an exact bound on the alignment score, then Smith-Waterman.

The benchmark is taken in blocks of bounded size; every block is one map-only pass over all
documents, so memory does not grow with either table.

1. A word of a document is worth 2 to an alignment if the item holds it, and costs 1 if not.
   The best run of words by this count bounds the score of every alignment from above.  It is
   taken for all items at once, without the words that most items hold: each place of such a
   word in the item is granted in full instead.
2. For the pairs left, the bound is taken again with all words, and two words that do not
   follow each other in the item cost 1 more.
3. The windows able to reach the least score are aligned with the item word by word (match
   +2, mismatch -1, gap -1).  The score is divided by that of the item with itself.

No step can lose an alignment that reaches the least score, however its words were edited.
Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.session import ship_package

from . import words as W
from .stage import free_name

MIN_SCORE, MIN_WORDS = 0.5, 8
#: Benchmark words per block: what one pass over the documents keeps in memory.
BLOCK_WORDS = 2_000_000
#: Benchmark words that are looked for at once, and (word, item) pairs in memory at once.
GROUP_WORDS, PAIRS = 20_000, 2_000_000
MATCH, MISMATCH, GAP = 2, -1, -1


class Group:
    """Items that are looked for at once: their words, and for every word the items it marks."""

    def __init__(self, items: list, min_score: float):
        self.items = items
        self.vocab = np.unique(np.concatenate([h for _, h in items]))
        self.words = [np.searchsorted(self.vocab, h) for _, h in items]
        self.need = np.array([max(min_score * MATCH * len(h), MATCH * min(MIN_WORDS, len(h))) for _, h in items])
        # words of an alignment that reaches need: m matches leave room for MATCH * m - need errors
        self.span = [int((1 + MATCH) * len(h) - n) for (_, h), n in zip(items, self.need)]
        holders = np.bincount(np.concatenate([np.unique(w) for w in self.words]), minlength=len(self.vocab))
        word, item, self.least = [], [], self.need.copy()
        for i, w in enumerate(self.words):
            own, places = np.unique(w, return_counts=True)
            order = np.lexsort((own, -holders[own]))
            cost = (MATCH - MISMATCH) * np.cumsum(places[order])
            left_out = int(np.searchsorted(cost, self.need[i] / 2, "right"))
            left_out = min(left_out, int((holders[own] > 1).sum()))
            self.least[i] -= cost[left_out - 1] if left_out else 0
            word.append(own[order[left_out:]])
            item.append(np.full(len(own) - left_out, i))
        word, item = np.concatenate(word), np.concatenate(item)
        order = np.argsort(word, kind="stable")
        self.marks = item[order].astype(np.uint16)          # numpy sorts 16 bits by radix
        self.first = np.searchsorted(word[order], np.arange(len(self.vocab) + 1))
        size = len(self.vocab) + 1
        self.pairs = [np.unique(w[:-1] * size + w[1:]) for w in self.words]

    def found(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Index in ``vocab`` of every word, its length for unknown ones; only those ``at`` may be known."""
        out = np.full(len(h), len(self.vocab))
        i = np.searchsorted(self.vocab, h[at])
        ok = i < len(self.vocab)
        ok[ok] = self.vocab[i[ok]] == h[at][ok]
        out[at[ok]] = i[ok]
        return out

    def candidates(self, row: np.ndarray, found: np.ndarray) -> np.ndarray:
        """(text, item) pairs whose bound reaches the least score, one number each."""
        at = np.flatnonzero(found < len(self.vocab))
        lo, n = self.first[found[at]], np.diff(self.first)[found[at]]
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        total, out, begin = np.concatenate(([0], np.cumsum(n))), [], 0
        while begin < len(at):
            # alignments that begin in the piece end in it or in its overlap with the next
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + PAIRS, "right")) - 1)
            stop = int(np.searchsorted(at, at[end - 1] + max(self.span), "right"))
            m = n[begin:stop]
            inner = np.arange(int(m.sum())) - np.repeat(total[begin:stop] - total[begin], m)
            item = self.marks[np.repeat(lo[begin:stop], m) + inner]
            order = np.argsort(item, kind="stable")
            item, place = item[order], np.repeat(at[begin:stop], m)[order]
            text = row[place]
            new = np.ones(len(item), bool)
            new[1:] = (item[1:] != item[:-1]) | (text[1:] != text[:-1])
            # a mark after a gap of g words adds MATCH - (g - 1); each pair lies below all before it
            worth = (MATCH - MISMATCH) * np.arange(len(item)) + MISMATCH * place
            worth -= np.cumsum(new) * (int(worth.max()) - int(worth.min()) + 1)
            good = MATCH + worth - np.minimum.accumulate(worth) >= self.least[item]
            out.append(np.unique(text[good].astype(np.int64) * len(self.items) + item[good]))
            begin = end
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def windows(self, i: int, found: np.ndarray) -> list[tuple[int, int]]:
        """Parts of a text that hold every alignment with item i that reaches its least score."""
        own = np.zeros(len(self.vocab) + 1, bool)
        own[self.words[i]] = True
        mark = own[found]
        worth = np.where(mark, MATCH, MISMATCH)
        both = np.flatnonzero(mark[1:] & mark[:-1]) + 1
        apart = ~np.isin(found[both - 1] * len(own) + found[both], self.pairs[i])
        worth[both[apart]] += GAP                   # matched both, a word of the item is left out
        total = np.concatenate(([0], np.cumsum(worth)))
        bound = total[1:] - np.minimum.accumulate(total[:-1]) - GAP      # the first word has none before it
        ends = np.flatnonzero(bound >= self.need[i])
        if not len(ends):
            return []
        cut = np.flatnonzero(np.diff(ends) > self.span[i])
        return [(max(0, int(lo) + 1 - self.span[i]), int(hi) + 1)
                for lo, hi in zip(ends[np.concatenate(([0], cut + 1))], ends[np.append(cut, len(ends) - 1)])]


class Block:
    """The items of one block, in groups."""

    def __init__(self, items: list, min_score: float):
        texts = pa.array([t for _, t in items], pa.string())
        row, h = W.words(texts, W.NON_ALNUM)
        cuts = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(items)))))
        self.groups, part, size = [], [], 0
        for i, (item, _) in enumerate(items):
            own = h[cuts[i]:cuts[i + 1]]
            if not len(own):
                continue
            if part and size + len(own) > GROUP_WORDS:
                self.groups.append(Group(part, min_score))
                part, size = [], 0
            part.append((item, own))
            size += len(own)
        if part:
            self.groups.append(Group(part, min_score))
        self.filter = np.zeros(1 << 22, bool)
        self.filter[_low(h)] = True


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << 22) - 1)).astype(np.int64)


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the window word where it ends."""
    best, end = 0, 0
    prev = np.zeros(len(window) + 1, np.int64)
    slope = np.arange(len(window) + 1, dtype=np.int64) * -GAP
    for w in item:
        cur = np.zeros(len(window) + 1, np.int64)
        cur[1:] = np.maximum(prev[:-1] + np.where(window == w, MATCH, MISMATCH), prev[1:] + GAP)
        np.maximum(cur, 0, out=cur)
        cur = np.maximum.accumulate(cur + slope) - slope        # gaps in the item
        j = int(cur.argmax())
        if cur[j] > best:
            best, end = int(cur[j]), j - 1
        prev = cur
    return best, end


def _leaks(block: Block, row: np.ndarray, h: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """(text, item id, score, first word of the window, word where the alignment ends)."""
    starts = np.searchsorted(row, np.arange(int(row[-1]) + 2)) if len(row) else np.zeros(1, np.int64)
    known, out = np.flatnonzero(block.filter[_low(h)]), []
    for group in block.groups:
        found = group.found(h, known)
        for pair in group.candidates(row, found).tolist():
            text, i = divmod(pair, len(group.items))
            begin, end = int(starts[text]), int(starts[text + 1])
            item, words = group.items[i]
            here = np.zeros(len(group.vocab) + 1, bool)
            here[found[begin:end]] = True
            if MATCH * here[group.words[i]].sum() < group.need[i]:
                continue                  # the score cannot exceed the share of words found
            best = (0.0, 0, 0)
            for lo, hi in group.windows(i, found[begin:end]):
                window = h[begin + lo:begin + hi]
                if MATCH * np.isin(words, window).sum() < group.need[i]:
                    continue
                score, last = align(words, window)
                if score >= group.need[i] and score / (MATCH * len(words)) > best[0]:
                    best = (score / (MATCH * len(words)), lo, lo + last)
            if best[0]:
                out.append((text, item, *best))
    return out


def _blocks(bench: DataFrame, item_col: str, text_col: str, min_score: float) -> Iterator[Block]:
    rows = bench.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.length("text") - F.length(F.regexp_replace("text", "[ \\t\\r\\n]+", "")) + 1)).first()[0] or 0
    parts = max(1, -(-int(total) // BLOCK_WORDS))
    for p in range(parts):
        own = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p)
        block = Block([(r.item, r.text) for r in own.collect()], min_score)   # BLOCK_WORDS words at most, about
        if block.groups:
            yield block


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, item_id, score, window_start, match_end) for each document that holds a copy,
    exact or edited, of an item: one row per document row and item, with its best score.

    score is 1 for a verbatim copy; at least ``min_score`` and ``MIN_WORDS`` matching words
    (all, if the item is shorter) are asked for.  Positions count words from 0.  Null or
    empty texts and items match nothing; items without words neither.  A null id is
    returned as null; repeated rows give repeated rows.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, score double, window_start long, match_end long"
    out = None
    for block in _blocks(bench, item_col, item_text_col, min_score):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches, shared=shared):
            b = shared.value
            for batch in batches:
                for part in W.chunks(batch, "text"):
                    hits = _leaks(b, *W.words(part.column("text"), W.NON_ALNUM))
                    if hits:
                        t, i, s, lo, end = zip(*hits)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(t)), pa.array(i, pa.int64()),
                             pa.array(s, pa.float64()), pa.array(lo, pa.int64()), pa.array(end, pa.int64())],
                            ["doc_id", "item_id", "score", "window_start", "match_end"])
        found = src.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` without a copy of any item, all columns as they were (rules as in
    ``contaminated``).  A filter inside the scan: nothing is shuffled."""
    ship_package(docs.sparkSession)
    text = free_name(docs, "scanned_text")
    out = docs.withColumn(text, F.col(text_col))
    for block in _blocks(bench, item_col, item_text_col, min_score):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            b = shared.value
            for batch in batches:
                for part in W.chunks(batch, text):
                    stay = np.ones(part.num_rows, bool)
                    stay[[x[0] for x in _leaks(b, *W.words(part.column(text), W.NON_ALNUM))]] = False
                    yield part.filter(pa.array(stay))
        out = out.mapInArrow(keep, out.schema)
    return out.select(*docs.columns)
