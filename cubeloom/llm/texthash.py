"""Vectorised 64-bit hashes of words and word runs over Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lowered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cubeloom.llm.runtime import string_buffers

SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(256)
    lowered = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    space = (byte == 32) | ((byte >= 9) & (byte <= 13))
    return mix(lowered.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)), space


_VALUE, _SPACE = _tables()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, SEGMENT + 4096)
        rows = []
        for step in (_BASE, _INVERSE):
            p = np.full(size, step, np.uint64)
            p[0] = 1
            rows.append(np.cumprod(p, dtype=np.uint64))
        if size > 4 * SEGMENT:
            return tuple(rows)
        have = _powers[0] = tuple(rows)
    return have


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, where each row's words begin: rows + 1)."""
    at, raw = string_buffers(column)
    n = len(at) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[1:-1]
    edge = edge[edge < len(raw)]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = edge[edge > 0] - 1
    last[before] = inside[before]
    ends = np.flatnonzero(last) + 1
    found = np.empty(len(starts), np.uint64)
    w = 0
    while w < len(starts):  # whole words, about a segment of bytes at a time
        lo = starts[w]
        to = max(w + 1, int(np.searchsorted(ends, lo + SEGMENT, "right")))
        hi = ends[to - 1]
        power, inverse = _power(int(hi - lo))
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_VALUE[raw[lo:hi]] * power[: hi - lo], out=total[1:])
        s, e = starts[w:to] - lo, ends[w:to] - lo
        found[w:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        w = to
    return found, np.searchsorted(starts, at)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n words, at its first word: len(hashes) - n + 1."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(total)]
    return mix(total + np.uint64(n))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The sorted set of n-word runs; with fewer words the whole as one; empty if none."""
    if not len(hashes):
        return hashes
    return np.unique(runs(hashes, min(n, len(hashes))))
