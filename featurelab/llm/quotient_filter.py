"""Counting quotient filters over sorted 64-bit fingerprints, in packed form.

A filter covers the fingerprints that begin with a prefix of ``s`` bits.  The ``q`` bits
after it are the quotient, the other ``r`` bits the remainder.  ``occupied`` marks the
quotients in use; their runs follow each other in one slot array, remainders ascending in a
run, and ``runend`` marks each run's last slot.  A remainder seen c > 1 times is followed
by the digits of c - 1 in slots marked ``counter``.  No bit of a fingerprint is lost, so
filters of any size merge without error: their runs list the fingerprints in order.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _low(bits: int) -> np.uint64:
    return _U((1 << bits) - 1)


def tally(fingerprints: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints ascending, and their counts added."""
    order = np.argsort(fingerprints, kind="stable")
    f = fingerprints[order]
    c = np.ones(len(f), np.int64) if counts is None else counts[order]
    first = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1]))) if len(f) else np.zeros(0, np.int64)
    return f[first], np.add.reduceat(c, first) if len(f) else c


def encode(fingerprints: np.ndarray, counts: np.ndarray, prefix_bits: int) -> bytes:
    """The filter of distinct ascending ``fingerprints`` that share a prefix (one at least)."""
    n, s = len(fingerprints), prefix_bits
    q = min(64 - s - 8, max(0, (n - 1).bit_length()))
    r = 64 - s - q
    body = fingerprints & _low(64 - s)
    quotient, rest = (body >> _U(r)).astype(np.int64), body & _low(r)
    more = counts.astype(np.uint64) - _U(1)
    digits, left = np.zeros(n, np.int64), more.copy()
    while left.any():
        digits += left > 0
        left = left >> _U(r)
    at = np.concatenate(([0], np.cumsum(1 + digits)))
    slots = np.zeros(at[-1], np.uint64)
    counter, runend = np.ones(at[-1], bool), np.zeros(at[-1], bool)
    slots[at[:-1]] = rest
    counter[at[:-1]] = False
    for level in range(int(digits.max())):
        has = np.flatnonzero(digits > level)
        slots[at[has] + 1 + level] = (more[has] >> _U(level * r)) & _low(r)
    runend[at[1:][np.concatenate((quotient[1:] != quotient[:-1], [True]))] - 1] = True
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    width = -(-r // 8)
    packed = slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    head = np.array([s, q, at[-1], int(fingerprints[0] >> _U(64 - s)) if s else 0], "<u8")
    return b"".join(x.tobytes() for x in (head, *map(np.packbits, (occupied, runend, counter)), np.ascontiguousarray(packed)))


def decode(filter_: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints ascending, and their counts."""
    s, q, n, prefix = (int(x) for x in np.frombuffer(filter_, "<u8", 4))
    r = 64 - s - q
    at = 32

    def bits(count: int) -> np.ndarray:
        nonlocal at
        size = -(-count // 8)
        out = np.unpackbits(np.frombuffer(filter_, np.uint8, size, at), count=count).astype(bool)
        at += size
        return out
    occupied, runend, counter = bits(1 << q), bits(n), bits(n)
    width = -(-r // 8)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(filter_, np.uint8, n * width, at).reshape(n, width)
    slots = wide.view("<u8").reshape(-1).astype(np.uint64)
    own = np.flatnonzero(~counter)
    run = np.cumsum(runend) - runend
    quotient = np.flatnonzero(occupied).astype(np.uint64)[run[own]]
    out = slots[own] | (quotient << _U(r)) if q else slots[own]
    if s:
        out = out | (_U(prefix) << _U(64 - s))
    counts = np.ones(len(own), np.int64)
    extra = np.flatnonzero(counter)
    if len(extra):
        owner = np.searchsorted(own, extra, "right") - 1
        level = (extra - own[owner] - 1).astype(np.uint64)
        np.add.at(counts, owner, (slots[extra] << (level * _U(r))).astype(np.int64))
    return out, counts


def merge(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and counts of all ``filters`` together; their ascending lists are merged
    (the stable sort finds the sorted stretches)."""
    parts = [decode(f) for f in filters]
    return tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
