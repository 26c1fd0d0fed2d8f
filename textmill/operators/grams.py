"""n-grams counted inside tasks: words are numbers there, and each distinct n-gram of a portion of rows is made a string once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.tokens import NGRAM_SIZES, words

PORTION_WORDS = 500_000  # words that are worked on at a time, or those of one row
HELD_COUNTS = 1_500_000  # counts of tokens that a task adds up before they go on


class Grams:
    """The n-grams of ``functions.tokens.ngrams`` in rows of words: their strings, and row and number of each occurrence."""

    def __init__(self, lists: pa.ListArray, ngram: str):
        lengths = lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(lists)), lengths)
        coded = lists.flatten().dictionary_encode()
        known, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        strings, rows, numbers, base = [known], [row], [word], len(known)
        last, number, place = known, word, np.arange(len(word))
        for n in range(2, NGRAM_SIZES.get(ngram, 1) + 1):
            # each n-gram is the (n-1)-gram at its place followed by the word n-1 places further on
            goes_on = place + n - 1 < len(word)
            place, number = place[goes_on], number[goes_on]
            goes_on = row[place] == row[place + n - 1]
            place, number = place[goes_on], number[goes_on]
            coded = pa.array(number * len(known) + word[place + n - 1]).dictionary_encode()
            pair, number = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
            last = pc.binary_join_element_wise(last.take(pa.array(pair // max(1, len(known)))), known.take(pa.array(pair % max(1, len(known)))), "_")
            strings.append(last)
            rows.append(row[place])
            numbers.append(number + base)
            base += len(last)
        self.strings, self.rows, self.numbers = pa.concat_arrays(strings), np.concatenate(rows), np.concatenate(numbers)
        if len(strings) > 1 and pc.any(pc.match_substring(known, "_")).as_py():
            # a word may read like an n-gram
            coded = self.strings.dictionary_encode()
            self.strings, self.numbers = coded.dictionary, coded.indices.to_numpy().astype(np.int64)[self.numbers]

    def counts(self, groups: np.ndarray, binary: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, number, n): how often each n-gram occurs in the rows of a group, or in how many of them."""
        size = max(1, len(self.strings))
        rows, numbers = self.rows, self.numbers
        if binary:
            once = pc.unique(pa.array(rows * size + numbers)).to_numpy()
            rows, numbers = once // size, once % size
        found = pc.value_counts(pa.array(groups[rows] * size + numbers))
        key = found.field("values").to_numpy()
        return key // size, key % size, found.field("counts").to_numpy()


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of at most PORTION_WORDS words, or of one row."""
    for batch in batches:
        reach = np.cumsum(batch.column("words").value_lengths().to_numpy().astype(np.int64))
        at = 0
        while at < len(reach):
            done = reach[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(reach, done + PORTION_WORDS, side="right")))
            yield batch.slice(at, to - at)
            at = to


def row_tokens(df: DataFrame, text: str, ngram: str, binary: bool, row_idx: str) -> DataFrame:
    """(row_idx, token, times): the distinct n-grams of each row; with ``binary`` all are there once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            grams = Grams(batch.column("words"), ngram)
            row, number, n = grams.counts(np.arange(batch.num_rows), binary)
            columns = [batch.column("id").take(pa.array(row)), grams.strings.take(pa.array(number)), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[row_idx, "token", "times"])

    kind = df.schema[row_idx].dataType.simpleString()
    listed = df.select(F.col(row_idx).alias("id"), words(F.col(text)).alias("words"))
    return listed.mapInArrow(work, f"`{row_idx}` {kind}, token string, times long")


def class_tokens(df: DataFrame, text: str, target: str, ngram: str, binary: bool) -> DataFrame:
    """(target, token, n): counts of n-grams by class, added up in portions; the parts are still to be summed."""

    def added(parts: list[pa.Table]) -> pa.Table:
        summed = pa.concat_tables(parts).combine_chunks().group_by(["target", "token"], use_threads=False).aggregate([("n", "sum")])
        return summed.rename_columns({"n_sum": "n"}).select(["target", "token", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in portions(batches):
            grams = Grams(batch.column("words"), ngram)
            coded = batch.column("target").dictionary_encode(null_encoding="encode")
            target_, number, n = grams.counts(coded.indices.to_numpy().astype(np.int64), binary)
            columns = [coded.dictionary.take(pa.array(target_)), grams.strings.take(pa.array(number)), pa.array(n, pa.int64())]
            held.append(pa.Table.from_arrays(columns, names=["target", "token", "n"]))
            size += len(n)
            if size > HELD_COUNTS:
                held = [added(held)]
                size = held[0].num_rows
                if 2 * size > HELD_COUNTS:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from added(held).to_batches()

    kind = df.schema[target].dataType.simpleString()
    listed = df.select(F.col(target).alias("target"), words(F.col(text)).alias("words"))
    return listed.mapInArrow(work, f"target {kind}, token string, n long")
