"""Word hashes straight from the UTF-8 bytes of an Arrow string column.

A word is a maximal run of bytes that are no separators.  Its 64-bit hash is a polynomial
over per-byte codes, taken from prefix sums over a whole segment of text, so that no
Python object is made per word.  Segments are at most ``SEGMENT`` bytes and end at
separators: memory does not grow with the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
CHUNK = 1 << 20                      # bytes of text that callers work on at a time
_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0x5851F42D4C957F2D           # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything in ASCII but letters and digits separates words.
NON_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes() -> np.ndarray:
    c = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN)) | np.uint64(1)
    c[65:91] = c[97:123]             # A-Z hash as a-z
    return c


_CODES = _codes()
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(max(n, SEGMENT) + 1, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count or pa.types.is_null(col.type):
        col = col.cast(pa.string()).fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(len(col) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _segments(off: np.ndarray, data: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, end = int(off[0]), int(off[-1])
    while lo < end:
        hi = min(lo + SEGMENT, end)
        if hi < end:
            start = int(off[np.searchsorted(off, hi, "right") - 1])
            if start > lo:
                hi = start
            else:                    # inside one text: end at a separator, ahead if there is none behind
                stop = int(off[np.searchsorted(off, lo, "right")])
                back = np.flatnonzero(sep[data[lo:hi]])
                if len(back):
                    hi = lo + int(back[-1]) + 1
                else:
                    while hi < stop:
                        ahead = np.flatnonzero(sep[data[hi:min(hi + SEGMENT, stop)]])
                        if len(ahead):
                            hi += int(ahead[0])
                            break
                        hi = min(hi + SEGMENT, stop)
        yield lo, hi
        lo = hi


def words(col: pa.Array, sep: np.ndarray = SPACES, spans: bool = False):
    """(row, hash) of every word in order; with ``spans`` also its first and end byte in its text."""
    off, data = buffers(col)
    rows, hashes, firsts, ends = [], [], [], []
    for lo, hi in _segments(off, data, sep):
        b = data[lo:hi]
        inside = ~sep[b]
        edge = np.zeros(hi - lo + 1, bool)
        edge[0] = edge[-1] = True
        cut = off[(off > lo) & (off < hi)] - lo
        edge[cut] = True
        before = np.concatenate(([False], inside[:-1]))
        after = np.concatenate((inside[1:], [False]))
        first = np.flatnonzero(inside & (~before | edge[:-1]))
        last = np.flatnonzero(inside & (~after | edge[1:]))
        if not len(first):
            continue
        up, down = _powers(hi - lo)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODES[b] * up[:hi - lo], dtype=np.uint64)))
        h = (sums[last + 1] - sums[first]) * down[first]
        hashes.append(mix(h + (last - first + 1).astype(np.uint64) * np.uint64(_GOLDEN)))
        row = np.searchsorted(off, first + lo, "right") - 1
        rows.append(row.astype(np.int32))
        if spans:
            firsts.append(first + lo - off[row])
            ends.append(last + 1 + lo - off[row])
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    out = cat(rows, np.int32), cat(hashes, np.uint64)
    return (*out, cat(firsts, np.int64), cat(ends, np.int64)) if spans else out


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` with about ``limit`` bytes of text each; a longer text stands alone."""
    off, _ = buffers(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield batch.slice(lo, min(hi, n) - lo)
        lo = min(hi, n)


def shingle_sets(row: np.ndarray, word: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles per row, sorted by (row, hash); a text of fewer than k words
    gives its whole word sequence as its one shingle; one without words gives none."""
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    out_row, out = [], []
    n = len(word) - k + 1
    if n > 0:
        same = row[:n] == row[k - 1:]
        h = _sequence([word[i:i + n][same] for i in range(k)])
        out_row.append(row[:n][same])
        out.append(h)
    for c in range(1, k):
        short = np.flatnonzero(count == c)
        if len(short):
            out_row.append(short.astype(np.int32))
            out.append(_sequence([word[first[short] + i] for i in range(c)]))
    if not out:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    r, h = np.concatenate(out_row), np.concatenate(out)
    order = np.argsort(r, kind="stable")
    r, h = r[order], h[order]
    ends = np.cumsum(np.bincount(r, minlength=n_rows))
    lo = 0
    for hi in ends.tolist():
        h[lo:hi].sort()
        lo = hi
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new], h[new]


def _sequence(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        h = mix(h * np.uint64(_BASE) + p)
    return h
