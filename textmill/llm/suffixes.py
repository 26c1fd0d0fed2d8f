"""Ordering byte strings of equal length by deep-shallow sorting.

Multikey sorting, eight bytes at a time, up to a shallow depth; groups that still share all of these bytes
are ordered by blind tries. A blind trie looks only at the bytes at which strings of a group branch: the
group's members are compared with one of them, the first byte at which any differs is its branching
depth, and the bytes there split the group. All groups are worked on side by side.
"""

from __future__ import annotations

import numpy as np

SHALLOW_WORDS = 2


def as_words(strings: np.ndarray) -> np.ndarray:
    """(n, bytes) to (n, words) of eight bytes, big-endian, filled with zeros."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    return padded.view(">u8").astype(np.uint64)


def _split(group: np.ndarray, key: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members ordered by (group, key), and where a new (group, key) starts."""
    order = np.lexsort((key, group))
    group, key = group[order], key[order]
    starts = np.ones(len(order), bool)
    starts[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    return members[order], starts


def deep_shallow(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): the strings in ascending order, and for each string the place at which its equals start."""
    n = len(strings)
    words = as_words(strings)
    order, first = np.arange(n), np.zeros(n, np.int64)  # first: the place at which a string's group starts
    places = np.arange(n)  # of the groups that are still open, in order

    def regroup(key_of) -> None:
        """Split the open groups by a key; the members stay within the places of their group."""
        nonlocal places
        members = order[places]
        members, starts = _split(first[members], key_of(members), members)
        order[places] = members
        begin = places[np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))]
        first[members] = begin
        # a group of one string is in order
        last = np.append(starts[1:], True)
        places = places[~(starts & last)]

    for depth in range(min(SHALLOW_WORDS, words.shape[1])):
        if len(places):
            regroup(lambda members, d=depth: words[members, d])
    while len(places):
        members = order[places]
        leader = order[first[members]]
        differs = words[members] ^ words[leader]
        word = (differs != 0).argmax(axis=1)
        value = differs[np.arange(len(members)), word]
        # first differing byte: eight times the word, and the zero bytes at the top of its value
        byte = np.full(len(members), words.shape[1] * 8)
        for b in range(7, -1, -1):
            byte[(value >> np.uint64(56 - 8 * b)) != 0] = b
        depth = np.where(value != 0, 8 * word + byte, words.shape[1] * 8)
        starts = np.flatnonzero(np.diff(first[members], prepend=-1))
        branch = np.minimum.reduceat(depth, starts)
        branch = np.repeat(branch, np.diff(np.append(starts, len(members))))
        open_ = branch < words.shape[1] * 8  # else all strings of the group are equal
        places, branch = places[open_], branch[open_]
        if len(places):
            depth_of = np.empty(n, np.int64)
            depth_of[order[places]] = branch

            def byte_at(members: np.ndarray, depth_of: np.ndarray = depth_of) -> np.ndarray:
                at = depth_of[members]
                return words[members, at // 8] >> (np.uint64(56) - 8 * (at % 8).astype(np.uint64)) & np.uint64(255)

            regroup(byte_at)
    return order, first
