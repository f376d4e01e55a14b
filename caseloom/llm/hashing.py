"""Hashes of words and word shingles, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def values(column, step: int = 256):
    """Python values of an Arrow column, a few at a time."""
    for k in range(0, len(column), step):
        yield from column.slice(k, step).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs get unrelated outputs."""
    y = x >> np.uint64(30)
    y ^= x
    y *= C
    y ^= y >> np.uint64(27)
    y *= D
    y ^= y >> np.uint64(31)
    return y


class WordHasher:
    """Hashes the words of a text after lower-casing A-Z; known words come from a bounded cache.

    ``clean`` is applied to each word first; what it leaves nothing of has the hash 0.
    """

    def __init__(self, limit: int = 150_000, clean=None):
        self.seen: dict[bytes, int] = {}
        self.limit, self.clean = limit, clean

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII letters and ASCII space
        seen = self.seen
        if len(seen) > self.limit:
            seen.clear()
        for w in set(words).difference(seen):
            bare = self.clean(w) if self.clean else w
            seen[w] = xxhash.xxh3_64_intdigest(bare) if bare else 0
        return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; of the whole sequence if it is shorter; nothing if it is empty."""
    if len(h) == 0:
        return h
    m = min(n, len(h))
    out = np.full(len(h) - m + 1, np.uint64(m))
    for j in range(m):
        out = mix64(out * A + h[j : len(h) - m + 1 + j] * B)
    return out


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(windows(h, n))
