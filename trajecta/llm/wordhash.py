"""Hashes of words and of runs of words, by arrays. A run's hash is made from the hashes of its
two halves by a multiplication and a mixing of all bits, again and again, so it is no polynomial
of the words; it serves to choose and to group, and equality is judged by digests."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Finder:
    """Places of numbers in an array of different ones, by a table that each process makes for
    itself (only the array is sent): the number itself is compared, so no two share a place."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys.astype(np.int64)
        self._slots: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {"keys": self.keys, "_slots": None}

    def _table(self) -> np.ndarray:
        if self._slots is None:
            self.bits = max(4, int(len(self.keys) * 2).bit_length())
            slots, row = np.full(1 << self.bits, -1, np.int32), np.arange(len(self.keys), dtype=np.int32)
            at = self._at(self.keys)
            while len(row):  # whoever gets a slot stays, the others go on
                free = slots[at] < 0
                slots[at[free]] = row[free]
                on = slots[at] != row
                row, at = row[on], at[on] + 1 & (1 << self.bits) - 1
            self._slots = slots
        return self._slots

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each number, ``len(self.keys)`` for one that is not there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        slots = self._table()
        at = self._at(keys)
        row = slots[at]
        out = np.where(row < 0, len(self.keys), row).astype(np.int64)
        on = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        while len(on):
            at[on] = at[on] + 1 & (1 << self.bits) - 1
            row = slots[at[on]]
            out[on] = np.where(row < 0, len(self.keys), row)
            on = on[(row >= 0) & (self.keys[row] != keys[on])]
        return out


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words from each word on, for all places that have so many."""
    out, have = mixed(words), 1
    while have < width and len(out):
        step = min(have, width - have)
        out = mixed(out[:-step] * _ODD + out[step:])
        have += step
    return out


def digests(line: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of a cryptographic digest of line[begin:end] for each pair, as two longs."""
    made = b"".join([hashlib.blake2b(line[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(made, "<i8").reshape(-1, 2)
