"""Numpy helpers for automata and tries that are stepped many rows at a time."""

from __future__ import annotations

import numpy as np


class Table:
    """A hash table of int64 keys to int32 values in numpy, read and written by whole arrays. Unknown keys give -1."""

    def __init__(self, bits: int = 16):
        self.bits, self.held = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            own = self.keys[at[open_]]
            out[open_] = np.where(own == keys[open_], self.values[at[open_]], -1)
            open_ = open_[(own != keys[open_]) & (own >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Of distinct keys that aren't held."""
        if 2 * (self.held + len(keys)) > 1 << self.bits:
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.__init__(max(self.bits + 1, int(4 * len(keys)).bit_length()))
        self.held += len(keys)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            placed = self.keys[at] == keys  # of several that want a place, the last written has it
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length)."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
