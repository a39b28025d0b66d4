"""A minimal perfect hash over unsigned 64-bit keys, level by level.

Each level hashes the keys that are left into a bit array somewhat larger than their number; a key
alone in its bit is placed there, the others go on to the next level. A key's slot is the number of
bits set before its own: constant time, and about four bits a key.
"""

from __future__ import annotations

import numpy as np

_GAMMA = 1.6


def mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser over keys and a salt."""
    x = keys.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """Slots 0..n-1 for n distinct keys; a key outside the set gets any slot, or n."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(np.unpackbits(bits, bitorder="little").reshape(-1, 64).sum(1), dtype=np.int64)]) if len(bits) else np.zeros(1, np.int64)
        self.n = int(self.before[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        left, sizes, flags = np.unique(keys.astype(np.uint64)), [], []
        while len(left):
            size = -(-int(len(left) * _GAMMA + 1) // 64) * 64
            at = mix(left, len(sizes)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            flags.append(alone)
            left = left[~alone[at.astype(np.int64)]]
        return cls(sizes, np.packbits(np.concatenate(flags), bitorder="little") if flags else np.zeros(0, np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, todo, base = np.full(len(keys), self.n, np.int64), np.arange(len(keys)), 0
        words = self.bits.view("<u8")
        for level, size in enumerate(self.sizes):
            at = base + (mix(keys[todo], level) % np.uint64(size)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self.before[at[hit] >> 6] + np.unpackbits(below.view(np.uint8).reshape(-1, 8), axis=1).sum(1)
            todo, base = todo[~hit], base + size
        return out
