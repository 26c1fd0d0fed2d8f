"""A minimal perfect hash of distinct 64-bit keys, by levels of bit arrays, with its keys for verification."""

from __future__ import annotations

import numpy as np

from textmill.llm.words import mix

ROOM = 2.0  # places of a level for each key that is left


class PerfectHash:
    """Maps n distinct keys one to one to 0 .. n - 1.

    On each level a key that no other one meets marks its place; keys that meet go on to the next level. A
    key's number is the number of marks before its own, counted by words of 64 places. About 4 bits a key;
    ``keys`` holds each key at its number, so that keys outside of the set are told apart exactly.
    """

    def __init__(self, keys: np.ndarray):
        left = keys.astype(np.uint64)
        self.sizes: list[int] = []
        marks = []
        while len(left):
            size = max(64, -(-int(ROOM * len(left)) // 64) * 64)
            at = _place(left, len(self.sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            marks.append(alone)
            self.sizes.append(size)
            left = left[~alone[at]]
        flat = np.concatenate(marks) if marks else np.zeros(0, bool)
        self.words = np.packbits(flat, bitorder="little").view(np.uint64)
        per_word = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(per_word) - per_word
        self.keys = np.zeros(len(keys), np.uint64)
        self.keys[self._numbers(keys.astype(np.uint64))] = keys

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; a key outside of the set gets any number or -1."""
        found = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = base + _place(keys[open_], level, size)
            bit = np.uint64(1) << (at & 63).astype(np.uint64)
            word = self.words[at >> 6]
            hit = (word & bit) != 0
            rank = self.before[at >> 6] + np.bitwise_count(word & (bit - np.uint64(1))).astype(np.int64)
            found[open_[hit]] = rank[hit]
            open_ = open_[~hit]
            base += size
        return found

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys outside of the set."""
        keys = keys.astype(np.uint64)
        found = self._numbers(keys)
        if not len(self.keys):
            return found
        return np.where((found >= 0) & (self.keys[found] == keys), found, -1)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    return (mix(keys ^ salt) % np.uint64(size)).astype(np.int64)
