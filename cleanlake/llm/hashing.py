"""A fixed table from 64-bit keys to integers that numpy arrays are looked up in at once."""

from __future__ import annotations

import numpy as np


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class HashTable:
    """Open addressing with linear probing, at most a quarter full; missing keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)
        keys, values = keys.astype(np.uint64), values.astype(np.int32)
        slot = mix64(keys) & self.mask
        left = np.arange(len(keys))
        while len(left):
            free = self.values[slot[left]] < 0
            at, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[at], self.values[at] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        shape, keys = keys.shape, keys.ravel()
        slot = mix64(keys) & self.mask
        out = self.values[slot]
        left = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(left):
            at = (slot[left] + np.uint64(1)) & self.mask
            slot[left] = at
            got = self.values[at]
            out[left] = got
            left = left[(got >= 0) & (self.keys[at] != keys[left])]
        return out.reshape(shape)
