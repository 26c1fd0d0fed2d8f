"""Words of Arrow text columns as numbers, and hashes of words and of stretches of characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textmill.llm.chunks import ragged

_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number, so that all bits depend on all bits."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class StretchHashes:
    """64-bit hashes of any stretches of a sequence of numbers, each in constant time."""

    def __init__(self, items: np.ndarray):
        n = len(items)
        # item j counts with the j-th power of the base; a stretch is brought back by the inverse of its start's
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(items.astype(np.uint64) * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(pow(_BASE, -1, 1 << 64), n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


def text_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of the word at each place, first place of each text and the end).

    Words are what white space separates, in lower case; null texts have none.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(column.cast(pa.string()), "")))
    flat = lists.flatten()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    # a text that is empty or starts or ends with white space gives empty words
    kept = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(kept)])
    edges = before[np.concatenate([[0], np.cumsum(lengths)])]
    words = flat.filter(pa.array(kept))
    del lists, flat, kept, before  # as large as the texts or larger
    coded = pc.dictionary_encode(words)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), edges


def gram_hashes(words: pa.Array, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hashes of its character stretches, number of them), ends of words marked."""
    shown = words.to_pylist()
    points = np.frombuffer(("\x02" + "\x02".join(shown) + "\x02").encode("utf-32-le", "surrogatepass"), np.uint32) if shown else np.array([2], np.uint32)
    marks = np.flatnonzero(points == 2)
    if len(marks) != len(shown) + 1:  # a word holds the mark itself
        return gram_hashes(pc.replace_substring(words, "\x02", "\x03"), sizes)
    hashes = StretchHashes(points)
    whole = hashes(marks[:-1], marks[1:])
    lengths = np.diff(marks) + 1  # with both marks
    counts = [np.maximum(lengths - n + 1, 0) for n in sizes]
    total = np.sum(counts, axis=0, dtype=np.int64) if counts else np.zeros(len(shown), np.int64)
    grams = np.empty(int(total.sum()), np.uint64)
    to = np.cumsum(total) - total  # where the next size's stretches of each word go
    for n, count in zip(sizes, counts, strict=True):
        starts = ragged(np.arange(len(points)), marks[:-1], count)
        grams[ragged(np.arange(len(grams)), to, count)] = hashes(starts, starts + n)
        to = to + count
    return whole, grams, total
