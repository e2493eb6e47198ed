"""A minimal perfect hash over distinct 128-bit keys: a number from 0 on for each key, without the keys themselves.

Levels of bit arrays: in each level the keys left are spread over twice as many bits; a bit that one key alone hits is set and
settles that key, the others go on to the next level. A key's number is the rank of its bit over all levels, read from
counts per word of 64 bits. After ``LEVELS`` levels the few keys left, if any, are kept in a sorted list and numbered last. The first half of a key gives the
places; the second half is its fingerprint, so that a key outside the set is told apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits for each key left in a level, and most levels.
SPACE = 2
LEVELS = 24
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _places(key: np.ndarray, level: int, bits: int) -> np.ndarray:
    h = (key ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) * _MIX
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(29)
    return h % np.uint64(bits)


@dataclass(frozen=True)
class PerfectHash:
    sizes: np.ndarray  # bits of each level
    words: np.ndarray  # the bits of all levels, each level from a new word on
    rest: np.ndarray  # keys that no level settled, sorted

    def __post_init__(self) -> None:
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        object.__setattr__(self, "before", before)

    @staticmethod
    def build(keys: np.ndarray) -> "PerfectHash":
        """``keys``: distinct unsigned 64-bit numbers."""
        left, sizes, words = keys, [], []
        while len(left) and len(sizes) < LEVELS:
            bits = max(64, SPACE * len(left))
            at = _places(left, len(sizes), bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            level = np.zeros(-(-bits // 64) * 64, dtype=np.uint8)
            level[:bits] = alone
            sizes.append(bits)
            words.append(np.packbits(level, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return PerfectHash(np.array(sizes, dtype=np.int64), np.concatenate(words) if words else np.zeros(0, dtype="<u8"), np.sort(left))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; for keys outside the set any number of the set or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        first = 0
        for level, bits in enumerate(self.sizes.tolist()):
            at = _places(keys[open_], level, bits)
            word = first + (at >> np.uint64(6)).astype(np.int64)
            inside = at & np.uint64(63)
            hit = (self.words[word] >> inside) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << inside[hit]) - np.uint64(1))
            out[open_[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            open_ = open_[~hit]
            first += -(-bits // 64)
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[at] == keys[open_]
            out[open_[same]] = self.before[-1] + at[same]
        return out
