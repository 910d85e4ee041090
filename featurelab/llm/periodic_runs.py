"""Runs of words with a period, found by multi-scale minimizers.

A run is a stretch of words in which words one period apart are identical, at least three
periods and 24 words long, that neither neighbour extends.  Periods up to 8 are found by
comparing the words with themselves at each lag.  Longer periods go by scale: scale
``low..high`` (high at most 1.25 low) hashes all stretches of ``high`` words and takes the
leftmost smallest hash of every ``2 low - high + 1`` neighbouring ones.

Why no run is missed: within a run of period p in low..high, equal stretches of high >= p
words lie a multiple of p apart.  Three periods hold a whole window of hashes and the same
window one period on, so their minima are equal, p apart, with no equal one between them:
neighbours in the list of equal minimizers.  Each such pair at a distance of the scale is
extended word by word in both directions, and kept if long enough and without a smaller
period.  Hashes only propose; words decide.

Texts of one batch are worked on together, longest first, divided by unique marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featurelab.session import ship_package

from . import words as W

LEAST_WORDS, LEAST_PERIODS, SHORT = 24, 3, 8
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] if n > 1 else out


def _reach(a: np.ndarray, at: int, lag: int, step: int) -> int:
    """How far equality with the word ``lag`` on holds from ``at`` in direction ``step``:
    blocks of doubling size, so time is linear in what holds."""
    done, size, last = 0, 32, len(a) - lag
    while True:
        lo, hi = (at + done, min(at + done + size, last)) if step > 0 else (max(0, at - done - size), at - done)
        if hi <= lo:
            return done
        bad = np.flatnonzero(a[lo:hi] != a[lo + lag:hi + lag])
        if len(bad):
            return done + (int(bad[0]) if step > 0 else hi - lo - 1 - int(bad[-1]))
        done, size = done + hi - lo, size * 2


def _smallest(a: np.ndarray, start: int, lag: int) -> bool:
    """Whether a stretch of three lags or more has no smaller period (it would divide the lag)."""
    return not any(np.array_equal(a[start:start + lag], a[start + lag // r:start + lag // r + lag]) for r in _primes(lag))


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the leftmost smallest hash of each ``w`` neighbouring ones."""
    bits = np.uint64(len(h).bit_length())
    m = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < w:
        m = np.minimum(m[:len(m) - (w - size)], m[w - size:])
    at = (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def _candidates(h: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, lag) of neighbouring equal minimizers at a distance of the scale."""
    at = _window_minima(h, 2 * low - high + 1)
    order = np.argsort(h[at], kind="stable")
    at = at[order]
    lag = at[1:] - at[:-1]
    good = (h[at[1:]] == h[at[:-1]]) & (lag >= low) & (lag <= high)
    return at[:-1][good], lag[good]


def stretches(a: np.ndarray, lengths: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in ``a``: texts of ``lengths`` words (descending),
    each followed by a mark that occurs once."""
    out = []
    for lag in range(1, SHORT + 1):
        if len(a) <= lag:
            break
        same = np.concatenate(([False], a[:-lag] == a[lag:], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        starts, ends = edge[::2], edge[1::2]
        for s, e in zip(starts[(long := ends - starts + lag >= LEAST_WORDS)].tolist(), ends[long].tolist()):
            if _smallest(a, s, lag):
                out.append((s, e - s + lag, lag))
    sizes, low = np.array(lengths), SHORT + 1
    ends = np.cumsum(sizes + 1)
    h, span = W.mix((a.astype(np.uint64) + np.uint64(1)) * _ODD), 1     # hashes of ``span`` words
    while n_long := int((sizes >= LEAST_PERIODS * low).sum()):
        high = max(low, low * 5 // 4)
        part = a[:ends[n_long - 1]]
        h = h[:len(part) - span + 1]
        while span * 2 <= high and len(h) > span:
            h, span = W.mix(h[:-span] * _ODD + h[span:]), span * 2
        over = high - span
        if len(h) > over:
            whole = W.mix(h[:len(h) - over] * _ODD + h[over:]) if over else h
            if len(whole) >= 2 * low - high + 1:
                at, lag = _candidates(whole, low, high)
                order = np.lexsort((at, lag))
                done, current = -1, 0
                for m, d in zip(at[order].tolist(), lag[order].tolist()):
                    if d == current and m < done:
                        continue             # the same stretch
                    s = m - _reach(a, m, d, -1)
                    e = m + _reach(a, m, d, 1)
                    current, done = d, e
                    if e - s + d >= max(LEAST_WORDS, LEAST_PERIODS * d) and _smallest(a, s, d):
                        out.append((s, e - s + d, d))
        low = high + 1
    return out


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets and words of all texts: maximal runs of no ASCII white space."""
    bounds, data = W.buffers(texts)
    data, bounds = data[bounds[0]:bounds[-1]], bounds - bounds[0]
    inside = ~W.SPACES[data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[bounds] = True
    first = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside))[:-1]))
    kept = np.concatenate(([0], np.cumsum(inside)))
    offsets = np.concatenate((kept[first], kept[-1:])).astype(np.int32)   # a column of strings ends at 2 GB
    flat = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return np.searchsorted(first, bounds), flat


def runs_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, list[list[tuple[int, int, int]]]]:
    """Word offsets, words, and the (start, length, period) of every run of every text."""
    off, flat = _split(texts)
    ids = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(off)
    order = [i for i in np.argsort(-sizes, kind="stable").tolist() if sizes[i] >= LEAST_WORDS]
    found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    if order:
        top = len(flat)
        parts = [x for k, i in enumerate(order) for x in (ids[off[i]:off[i + 1]], [top + k])]
        begin = np.concatenate(([0], np.cumsum(sizes[order] + 1)))
        for s, n, p in stretches(np.concatenate(parts), sizes[order].tolist()):
            k = int(np.searchsorted(begin, s, "right")) - 1
            found[order[k]].append((s - int(begin[k]), n, p))
    for rows in found:
        rows.sort(key=lambda r: (r[0], r[2]))
    return off, flat, found


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs``.

    ``runs`` lists (start, length, period) of every run of the whole text by start, then
    period, in words ``[^\\x20\\x09-\\x0D]+`` numbered from 0; ``collapsed`` is the text with
    one space between words and without what repeats: words that any run holds after its
    first period go.  Null and empty texts have no words, no runs and an empty ``collapsed``.  Null ids
    and repeated rows stay; no rows give none; other columns are not read, whatever their
    names.  A text is worked on whole, in memory: about 100 bytes a word.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "text"):
                off, flat, found = runs_of(part.column("text"))
                drop = np.zeros(len(flat) + 1, np.int32)
                for lo, rows in zip(off.tolist(), found):
                    for s, n, p in rows:
                        drop[lo + s + p] += 1
                        drop[lo + s + n] -= 1
                keep = np.cumsum(drop)[:-1] == 0
                left = np.concatenate(([0], np.cumsum(keep)))[off]
                words = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(keep)))
                runs = [[{"start": s, "length": n, "period": p} for s, n, p in rows] for rows in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(off).astype(np.int64)), pa.array(runs, pa.list_(_RUN)),
                     pc.binary_join(words, " ")], ["doc_id", "n_words", "runs", "collapsed"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
