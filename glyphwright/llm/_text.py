"""Whole Arrow text columns as numpy arrays: bytes, words and their hashes, without a loop over rows."""

from __future__ import annotations

import numpy as np

from ..functions.scan import raw, slabs  # noqa: F401

_rng = np.random.default_rng(20240229)
#: One table per position in a word: the hash of a word is the sum of its bytes' entries.
TABLES = _rng.integers(0, 1 << 64, (64, 256), dtype=np.uint64)
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: a run of ASCII letters, digits and non-ASCII bytes."""
    w = IS_WORD[data]
    start = w.copy()
    start[1:] &= ~w[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[firsts] = w[firsts]
    end = w.copy()
    end[:-1] &= ~w[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[lasts] = w[lasts]
    a = np.flatnonzero(start)
    return a, np.flatnonzero(end) + 1, np.searchsorted(offsets, a, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same for upper and lower case of ASCII."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    base = np.cumsum(size) - size
    total = int(size.sum())
    pos = np.arange(total, dtype=np.int32) - np.repeat(base.astype(np.int32), size)
    letters = data if total == len(data) else data[pos + np.repeat(start.astype(np.int32), size)]
    entry = TABLES.ravel().take(((pos & 63) << 8) + LOWER.take(letters))
    if len(size) and size.max() > 64:
        entry = entry + (pos >> 6).astype(np.uint64)
    sums = np.add.reduceat(entry, base)
    return mix(sums + size.astype(np.uint64))
