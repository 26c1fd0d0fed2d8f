"""Which words of a table are part of which texts, as substrings, met block by block.

Texts and words are dealt into blocks of a bounded number of bytes; each pair of blocks is one group of one task. There the
words are a tree, and all places of the texts walk down it together, a byte at a time, until no word goes on like them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_BYTES, WORD_BYTES = 16 << 20, 1 << 19  # bytes of a block at most, but for a longer text or word
LEAST_BYTES, SOME_BLOCKS = 1 << 20, 16  # smaller tables of texts are cut into up to so many blocks of at least so many bytes
WALKED_BYTES, CELLS = 4 << 20, 1 << 25  # bytes of texts, and texts times words, that are looked at a time
MOST_PARTITIONS = 1000
ROOT, NO_TEXT = 1, 255  # node 0 has no way on; the other is a byte of no UTF-8 text
DEPTH = 64  # bytes of a word that are in the tree; what follows is looked for in the texts that hold these


def joined_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, length of each)."""
    lengths = pc.binary_length(column).to_numpy().astype(np.int64)
    parts = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk) and at[-1] > at[0]:
            parts.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]])
    return np.concatenate(parts or [np.empty(0, np.uint8)]), lengths


class WordTree:
    """Distinct words, none empty, as a tree over half bytes: 16 children a node, whatever the alphabet."""

    def __init__(self, words: pa.ChunkedArray):
        data, lengths = joined_bytes(words)
        halves = np.stack([data >> 4, data & 15], axis=1).reshape(-1)
        starts = np.cumsum(lengths) - lengths
        node, total, edges = np.full(len(lengths), ROOT, np.int64), ROOT + 1, []
        active, level = np.arange(len(lengths)), 0
        while len(active):
            keys, child = np.unique(node[active] * 16 + halves[2 * starts[active] + level], return_inverse=True)
            edges.append(keys)
            node[active] = total + child
            total += len(keys)
            level += 1
            active = active[2 * np.minimum(lengths[active], DEPTH) > level]
        self.child = np.zeros(16 * total, np.int32)
        self.child[np.concatenate(edges)] = np.arange(ROOT + 1, total)  # nodes were numbered in this order
        ends, self.start = np.unique(node, return_inverse=True)  # words with the same first bytes have the same start
        self.starts = len(ends)
        self.number = np.full(total, -1, np.int32)
        self.number[ends] = np.arange(self.starts)
        self.first = self._next(np.full(256, ROOT, np.int32), np.arange(256))
        self.long = {int(i): data[starts[i] : starts[i] + lengths[i]].tobytes() for i in np.flatnonzero(lengths > DEPTH)}

    def _next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return self.child[self.child[node * 16 + (byte >> 4)] * 16 + (byte & 15)]

    def held(self, data: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first text, texts x words: whether a text holds a word), some texts at a time."""
        ends = np.cumsum(lengths)
        at = 0
        while at < len(lengths):
            start = int(ends[at] - lengths[at])
            to = int(np.searchsorted(ends, start + WALKED_BYTES, side="right"))
            to = max(at + 1, min(to, at + CELLS // len(self.start)))
            seen = self._walk(data[start : ends[to - 1]], lengths[at:to])[:, self.start]
            for i, word in self.long.items():
                for row in np.flatnonzero(seen[:, i]).tolist():
                    end = ends[at + row]
                    seen[row, i] = word in data[end - lengths[at + row] : end].tobytes()
            yield at, seen
            at = to

    def _walk(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        seen = np.zeros((len(lengths), self.starts), bool)
        cells = seen.reshape(-1)
        data = np.insert(data, np.cumsum(lengths), NO_TEXT)  # ends all walks at the end of a text
        text = np.repeat(np.arange(len(lengths)), lengths + 1)
        node = self.first[data]
        place = np.flatnonzero(node)
        node = node[place]
        while len(place):
            number = self.number[node]
            ended = np.flatnonzero(number >= 0)
            cells[text[place[ended]] * self.starts + number[ended]] = True
            place = place + 1
            node = self._next(node, data[place])
            alive = np.flatnonzero(node)
            place, node = place[alive], node[alive]
        return seen


def meet_words(
    texts: DataFrame, words: DataFrame, found: Callable[[pa.Table, pa.Table, int, np.ndarray], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """What ``found`` makes of each block of ``texts`` (id, text) and each block of distinct ``words`` (text, tags).

    It gets the texts and the words of a group, the number of a text, and whether that one and the next ones hold the words.
    """
    numbers = []
    for side, most, some in ((texts, TEXT_BYTES, SOME_BLOCKS), (words, WORD_BYTES, 1)):
        total = side.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        numbers.append(max(-(-total // most), min(some, -(-total // LEAST_BYTES)), 1))
    own = [F.pmod(F.xxhash64(*c), F.lit(n)).alias(a) for c, n, a in ((("id", "text"), numbers[0], "__a"), (("text",), numbers[1], "__b"))]
    every = [F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(a) for n, a in zip(numbers, ("__a", "__b"), strict=True)]
    none = lambda of, c: F.lit(None).cast(of.schema[c].dataType).alias(c)
    met = texts.select("id", "text", none(words, "tags"), F.lit(0).alias("side"), own[0], every[1]).unionByName(
        words.select(none(texts, "id"), "text", "tags", F.lit(1).alias("side"), every[0], own[1])
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        asked, listed = (table.filter(pc.equal(table["side"], s)) for s in (0, 1))
        if not asked.num_rows or not listed.num_rows:
            return
        tree = WordTree(listed["text"])
        for at, seen in tree.held(*joined_bytes(asked["text"])):
            yield from found(asked, listed, at, seen)

    dealt = met.repartition(max(1, min(2 * numbers[0] * numbers[1], MOST_PARTITIONS)), "__a", "__b")
    return dealt.groupBy("__a", "__b").applyInArrow(work, schema)
