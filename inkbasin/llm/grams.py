"""A growing set of 64-bit keys with counts: open addressing, whole arrays at a time."""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)  # never a key: keys have fewer than 64 bits


class KeyTable:
    """Keys get indexes 1, 2, ... in the order they come; index 0 stands for absent."""

    def __init__(self, bits: int = 16):
        self.n = 0
        self.keys = np.full(1 << 10, _NONE, np.uint64)
        self._size(bits)

    def _size(self, bits: int) -> None:
        self.bits, self.slots = bits, np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, 0 where absent."""
        at = self._slot(keys)
        found = self.slots[at]
        open_ = np.flatnonzero((self.keys[found] != keys) & (found != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            found[open_] = self.slots[at[open_]]
            open_ = open_[(self.keys[found[open_]] != keys[open_]) & (found[open_] != 0)]
        return found

    def add(self, keys: np.ndarray) -> None:
        """Add distinct keys that are not in the table yet."""
        first = self.n + 1
        self.n += len(keys)
        if self.n + 1 > len(self.keys):
            self.keys = np.concatenate([self.keys, np.full(max(self.n + 1, len(self.keys)), _NONE, np.uint64)])
        self.keys[first : self.n + 1] = keys
        if 4 * self.n > len(self.slots):
            self._size(max(self.bits + 1, (4 * self.n - 1).bit_length()))
            first = 1
        self._place(first)

    def _place(self, first: int) -> None:
        index = np.arange(first, self.n + 1, dtype=np.int32)
        at = self._slot(self.keys[index])
        while len(index):
            free = self.slots[at] == 0
            self.slots[at[free]] = index[free]
            left = self.slots[at] != index
            index, at = index[left], (at[left] + 1) & (len(self.slots) - 1)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, adding those that are new."""
        found = self.find(keys)
        new = found == 0
        if new.any():
            self.add(np.unique(keys[new]))
            found[new] = self.find(keys[new])
        return found
