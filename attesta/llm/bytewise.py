"""Words and their hashes from the bytes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of letters, digits and anything beyond ASCII, after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words of anything but ASCII white space.
SPACED = np.ones(256, bool)
SPACED[9:14] = SPACED[32] = False


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(max(n, 1024), _STEP, np.uint64)
        more[0] = 1
        _POWERS = np.multiply.accumulate(more)
    return _POWERS[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def batches_of_texts(starts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``limit`` bytes at most; a longer text stands alone."""
    lo, n = 0, len(starts) - 1
    while lo < n:
        hi = int(np.searchsorted(starts, starts[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, starts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): 64-bit hashes of the lower-cased words in order; text i has hashes[bounds[i]:bounds[i + 1]].

    A word's hash sums, modulo 2**64, a random number for each byte times an odd constant's power for its place;
    it is never 0.  Two different words share one with a chance of about 2**-64.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    low = LOWER[data]
    inside = kind[low]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = starts[:-1][starts[:-1] < n]
    begin[edge] = inside[edge]
    first = np.flatnonzero(begin)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    at = np.flatnonzero(inside)
    word = np.cumsum(begin[at]) - 1
    place = at - first[word]
    parts = _BYTE[low[at]] * powers(int(place.max()) + 1)[place]
    runs = np.searchsorted(at, first)
    h = mix(np.add.reduceat(parts, runs))
    h[h == 0] = 1
    return h, np.searchsorted(first, starts)
