"""Numbers of 64-bit keys in flat arrays: looked up and added many at a time."""

from __future__ import annotations

import numpy as np

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Numbers:
    """Keys get the numbers 0, 1, 2 ... in the order in which they come."""

    def __init__(self) -> None:
        self.keys = np.zeros(1024, np.uint64)
        self.size = 0
        self._spread(12)

    def __len__(self) -> int:
        return self.size

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.table.nbytes

    def _spread(self, bits: int) -> None:
        self.bits = bits
        self.table = np.full(1 << bits, -1, np.int32)
        self._place(np.arange(self.size, dtype=np.int32))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, numbers: np.ndarray) -> None:
        slot, mask = self._slots(self.keys[numbers]), (1 << self.bits) - 1
        while len(numbers):
            free = self.table[slot] < 0
            self.table[slot[free]] = numbers[free]
            left = self.table[slot] != numbers  # of several keys at one slot one has won
            numbers, slot = numbers[left], (slot[left] + 1) & mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for a key that has none."""
        out = np.full(len(keys), -1, np.int64)
        slot, mask = self._slots(keys), (1 << self.bits) - 1
        todo = np.arange(len(keys))
        while len(todo):
            got = self.table[slot]
            there = got >= 0
            hit = there & (self.keys[got] == keys[todo])
            out[todo[hit]] = got[hit]
            on = there & ~hit
            todo, slot = todo[on], (slot[on] + 1) & mask
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys that have none yet. A key that comes twice gets two, one of which is found."""
        n = self.size + len(keys)
        if n > len(self.keys):
            self.keys = np.concatenate([self.keys[: self.size], np.zeros(max(n, 2 * len(self.keys)) - self.size, np.uint64)])
        self.keys[self.size : n] = keys
        numbers = np.arange(self.size, n, dtype=np.int32)
        self.size = n
        if 2 * n > 1 << self.bits:
            self._spread(int(2 * n).bit_length())
        else:
            self._place(numbers)
        return numbers.astype(np.int64)
