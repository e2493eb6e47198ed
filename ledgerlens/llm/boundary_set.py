"""An ordered set of whole numbers in containers of 2**16, with select by rank.

A container holds the low 16 bits of its members in the form that takes the least room: an array (two bytes a member),
a bitmap (8,192 bytes) or runs (four bytes a run). Cumulative cardinalities say which container holds a rank; the
place inside it is found by indexing (array), by counts per word of 64 bits (bitmap) or by cumulative run lengths (runs).
"""

from __future__ import annotations

import numpy as np

#: Members of a container, and bytes of its bitmap.
CONTAINER = 1 << 16
BITMAP_BYTES = CONTAINER // 8


class ArrayContainer:
    kind = "array"

    def __init__(self, low: np.ndarray) -> None:
        self.low = low.astype(np.uint16)

    def select(self, rank: int) -> int:
        return int(self.low[rank])


class BitmapContainer:
    kind = "bitmap"

    def __init__(self, low: np.ndarray) -> None:
        bits = np.zeros(CONTAINER, dtype=np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.until = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def select(self, rank: int) -> int:
        at = int(np.searchsorted(self.until, rank, side="right"))
        left = rank - (int(self.until[at - 1]) if at else 0)
        word = int(self.words[at])
        for _ in range(left):
            word &= word - 1  # without its lowest member
        return at * 64 + (word & -word).bit_length() - 1


class RunContainer:
    kind = "run"

    def __init__(self, first: np.ndarray, length: np.ndarray) -> None:
        self.first = first.astype(np.uint16)
        self.until = np.cumsum(length, dtype=np.int64)

    def select(self, rank: int) -> int:
        at = int(np.searchsorted(self.until, rank, side="right"))
        return int(self.first[at]) + rank - (int(self.until[at - 1]) if at else 0)


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest form for the sorted members ``low`` (0 to 65,535, at least one)."""
    starts = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    size = {"run": 4 * len(starts), "array": 2 * len(low), "bitmap": BITMAP_BYTES}
    kind = min(size, key=size.get)
    if kind == "run":
        return RunContainer(low[starts], np.diff(np.append(starts, len(low))))
    return ArrayContainer(low) if kind == "array" else BitmapContainer(low)


class BoundarySet:
    """The members of a sorted array of distinct whole numbers from 0 on."""

    def __init__(self, members: np.ndarray) -> None:
        high = members // CONTAINER
        cuts = np.flatnonzero(np.diff(high, prepend=-1))
        self.high = high[cuts]
        self.containers = [container(part % CONTAINER) for part in np.split(members, cuts[1:])] if len(members) else []
        self.until = np.append(cuts[1:], len(members)) if len(members) else np.zeros(0, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.until[-1]) if len(self.until) else 0

    def select(self, rank: int) -> int:
        """The member with ``rank`` smaller ones."""
        if not 0 <= rank < len(self):
            raise IndexError(rank)
        at = int(np.searchsorted(self.until, rank, side="right"))
        before = int(self.until[at - 1]) if at else 0
        return int(self.high[at]) * CONTAINER + self.containers[at].select(rank - before)


def character_boundaries(data: bytes) -> BoundarySet:
    """Byte offsets at which a code point of a UTF-8 text starts, and its end."""
    lead = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
    return BoundarySet(np.flatnonzero(np.append(lead, True)))
