"""Vectorised text work over the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: [\x20\x09-\x0D]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its values; a null counts as empty."""
    a = column.fill_null("") if column.null_count else column
    a = a.cast(pa.large_string())
    n = len(a)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + n + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of values that hold up to ``most`` bytes together (one value may hold more)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_MULT = np.zeros(0, np.uint64)


def multipliers(n: int) -> np.ndarray:
    """Odd multipliers for byte positions 0..n-1 of a word."""
    global _MULT
    if len(_MULT) < n:
        _MULT = mix(np.arange(1, max(n, 256) + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    return _MULT


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit fingerprints of all words, the index of each one's text, and where each begins."""
    n = len(data)
    solid = ~SPACE[data] if n else np.zeros(0, bool)
    fresh = np.zeros(n + 1, bool)
    fresh[offsets[:-1]] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | fresh[1:n]
    at = np.flatnonzero(start)
    if len(at) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), at
    inside = np.flatnonzero(solid)
    which = np.cumsum(start[inside]) - 1
    pos = inside - at[which]
    mult = multipliers(int(pos.max()) + 1)
    value = (LOWER[data[inside]] if lower else data[inside]).astype(np.uint64) + U64(1)
    value *= mult[pos]
    h = mix(np.add.reduceat(value, np.searchsorted(inside, at)))
    return h, np.searchsorted(offsets, at, side="right") - 1, at


_Q = mix(np.arange(101, 120, dtype=np.uint64)) | U64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct 64-bit fingerprints of its word n-grams; fewer words: all as one; none: empty."""
    h, doc, _ = words(data, offsets)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    if len(h) >= size:
        m = len(h) - size + 1
        grams = np.zeros(m, np.uint64)
        for j in range(size):
            grams += h[j : j + m] * _Q[j]
        grams = mix(grams)
    else:
        grams = np.zeros(0, np.uint64)
    for i in range(len(offsets) - 1):
        n, a = int(count[i]), int(first[i])
        if n >= size:
            yield np.unique(grams[a : a + n - size + 1])
        elif n:
            yield mix((h[a : a + n] * _Q[:n]).sum(dtype=np.uint64, keepdims=True) + U64(7919 * n))
        else:
            yield np.zeros(0, np.uint64)
