"""Words of a text as 64-bit hashes, computed on whole byte arrays.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``, with A-Z lower-cased. Its hash
is a polynomial of random byte values, modulo 2^64, then mixed. Two different words collide
with probability about 2^-64, so counts by hash are counts by word up to V^2 / 2^65.
"""

from __future__ import annotations

from functools import cache

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 2^bits of each."""
    n = 1 << bits
    up, down = np.full(n, _U(_BASE)), np.full(n, _U(pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finalizer: every output bit depends on every input bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def word_hashes(text: str | None) -> np.ndarray:
    """One uint64 for each word, in order; nothing for null or blank text."""
    return word_starts((text or "").encode("utf-8", "surrogatepass"))[0]


def word_starts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The same for UTF-8, and the place of each word's first byte."""
    if not data:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    a = np.frombuffer(data.lower(), np.uint8)
    up, down = _powers(max(16, len(a).bit_length()))
    edges = np.diff(np.concatenate(([1], _SPACE[a].view(np.int8), [1])))
    start, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    sums = np.zeros(len(a) + 1, _U)
    np.cumsum(_BYTES[a] * up[: len(a)], dtype=_U, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start]), start


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``n`` words; fewer words make one run."""
    if not len(words):
        return words
    width = min(n, len(words))
    count = len(words) - width + 1
    h = np.full(count, _U(width))
    for j in range(width):
        h = h * _U(_BASE) + words[j : j + count]
    return np.unique(mix(h))
