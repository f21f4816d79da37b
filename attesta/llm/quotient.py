"""A counting quotient filter without loss: the whole key can be read back from where it stands.

A key of 2 * ``half`` bits is permuted by a Feistel network, which can be inverted.  The upper bits of the result are the
shard, the next ``q`` bits the quotient, and all other bits the remainder, so nothing of a key is dropped and no two
keys share a counter.  A filter holds its entries in the order of the permuted keys: a bit for each quotient that occurs, a bit for
each entry that ends its quotient's run, the remainders packed in whole bytes, and counters of seven bits a byte, of which most take one.
Sorted filters merge in one pass.
"""

from __future__ import annotations

import numpy as np

from .bytewise import mix

ROUNDS = tuple(np.uint64(0x9E3779B97F4A7C15 * k & (2**64 - 1)) for k in (1, 3, 5, 7))


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permute(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for k in ROUNDS:
        left, right = right, left ^ (mix(right ^ k) & _mask(half))
    return left, right


def restore(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for k in reversed(ROUNDS):
        left, right = right ^ (mix(left ^ k) & _mask(half)), left
    return left, right


def sort_and_sum(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, with the sums of their counts (None: one each)."""
    if not len(left):
        return left, right, np.zeros(0, np.int64)
    if 2 * half <= 64:
        key = (left << np.uint64(half)) | right if half < 64 else left
        if counts is None:
            key = np.sort(key)
        else:
            order = np.argsort(key, kind="stable")
            key, counts = key[order], counts[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        left, right = key[new] >> np.uint64(half), key[new] & _mask(half)
        total = len(key)
    else:
        order = np.lexsort((right, left))
        left, right, counts = left[order], right[order], None if counts is None else counts[order]
        new = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
        total, left, right = len(left), left[new], right[new]
    return left, right, np.diff(np.append(new, total)) if counts is None else np.add.reduceat(counts, new)


def _varints(values: np.ndarray) -> np.ndarray:
    """Seven bits a byte, the lowest first; a set upper bit says that more follow."""
    v = values.astype(np.uint64)
    n = np.ones(len(v), np.int64)
    for k in range(1, 10):
        n += v >= np.uint64(1 << 7 * k)
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0)
    own = np.repeat(np.arange(len(v)), n)
    step = (at - (ends - n)[own]).astype(np.uint64)
    return (((v[own] >> (np.uint64(7) * step)) & np.uint64(127)) | np.where(at < ends[own] - 1, 128, 0).astype(np.uint64)).astype(np.uint8)


def _read_varints(data: np.ndarray) -> np.ndarray:
    last = data < 128
    first = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(data) else np.zeros(0, np.int64)
    own = np.cumsum(last) - last
    step = (np.arange(len(data)) - first[own]).astype(np.uint64)
    return np.add.reduceat((data & 127).astype(np.uint64) << (np.uint64(7) * step), first).astype(np.int64) if len(data) else np.zeros(0, np.int64)


class QuotientFilter:
    """Entries of one shard: ``left`` (without the shard's bits) and ``right`` in order, and their counts.

    ``room``: bits of ``left``; ``q`` of them are the quotient.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray, room: int, half: int):
        self.left, self.right, self.counts, self.room, self.half = left, right, counts, room, half

    def __len__(self) -> int:
        return len(self.left)

    def to_bytes(self) -> bytes:
        n = len(self)
        q = min(self.room, max(1, n.bit_length()))
        quotient = (self.left >> np.uint64(self.room - q)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        runends = np.append(quotient[1:] != quotient[:-1], True)[:n]
        rest = self.left & _mask(self.room - q)
        wide = lambda x, bits: x.astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - (bits + 7) // 8 :]
        remainders = np.concatenate([wide(rest, self.room - q), wide(self.right, self.half)], axis=1)
        return b"".join([n.to_bytes(8, "big"), bytes([q, self.room, self.half]), np.packbits(occupied).tobytes(), np.packbits(runends).tobytes(), remainders.tobytes(), _varints(self.counts).tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> QuotientFilter:
        n, q, room, half = int.from_bytes(raw[:8], "big"), *raw[8:11]
        data, at = np.frombuffer(raw, np.uint8), 11

        def take(k: int) -> np.ndarray:
            nonlocal at
            at += k
            return data[at - k : at]

        occupied = np.flatnonzero(np.unpackbits(take(((1 << q) + 7) // 8), count=1 << q))
        runends = np.unpackbits(take((n + 7) // 8), count=n).astype(np.int64)
        quotient = occupied[np.cumsum(runends) - runends].astype(np.uint64)
        a, b = (room - q + 7) // 8, (half + 7) // 8
        remainders = take(n * (a + b)).reshape(n, a + b)

        def narrow(x: np.ndarray) -> np.ndarray:
            out = np.zeros((n, 8), np.uint8)
            out[:, 8 - x.shape[1] :] = x
            return out.view(">u8").reshape(n).astype(np.uint64)

        left = (quotient << np.uint64(room - q)) | narrow(remainders[:, :a])
        return cls(left, narrow(remainders[:, a:]), _read_varints(data[at:]), room, half)

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """One filter of the summed counters of filters of one shard."""
        if len(filters) == 1:
            return filters[0]
        left, right, counts = (np.concatenate([getattr(f, k) for f in filters]) for k in ("left", "right", "counts"))
        return cls(*sort_and_sum(left, right, counts, filters[0].half), filters[0].room, filters[0].half)

    def count(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The counters of permuted keys without their shard's bits, 0 where there is none."""
        out = np.zeros(len(left), np.int64)
        lo, hi = np.searchsorted(self.left, left, "left"), np.searchsorted(self.left, left, "right")
        for i in np.flatnonzero(lo < hi).tolist():
            j = lo[i] + int(np.searchsorted(self.right[lo[i] : hi[i]], right[i]))
            if j < hi[i] and self.right[j] == right[i]:
                out[i] = self.counts[j]
        return out


def filters(left: np.ndarray, right: np.ndarray, counts: np.ndarray, half: int, shard_bits: int) -> list[tuple[int, QuotientFilter]]:
    """(shard, filter) of sorted permuted keys, cut by their upper ``shard_bits``."""
    if not len(left):
        return []
    room = half - shard_bits
    shard = (left >> np.uint64(room)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    return [(int(shard[a]), QuotientFilter(left[a:b] & _mask(room), right[a:b], counts[a:b], room, half)) for a, b in zip(first, np.append(first[1:], len(left)))]
