"""Approximate nearest neighbours by cross-polytope hashing.

A table turns a unit vector by three rounds of random signs and a fast Hadamard transform and assigns it
to the nearest of the signed axes. Queries look into the buckets of several axes in each table. The rows
that enough tables bring are scored exactly. Every row is in every table; the tables of a block of rows
are searched by all queries. Rows are hashed in bands of similar length, each scaled by its own longest
row; a query leaves a band out only where its longest row cannot reach the k-th score found so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.blocks import best, finite_vectors, grid_of, leading, search_blocks
from textmill.llm.chunks import ragged
from textmill.llm.common import table
from textmill.llm.registry import query

TABLES = 48
PROBES = 8  # buckets of each table that a query looks into, for 64 axes; in proportion for more
VOTES = 7  # tables that have to bring a row
AT_LEAST = 400  # rows of a band of a block that are scored at least; fewer votes are enough if they are missing
BAND = 1.1  # longest to shortest length of a band
SEED = 20
COLUMNS_AT_A_TIME = 1024  # few enough for the processor's cache


def hadamard(columns: np.ndarray) -> None:
    """The fast Hadamard transform of each column, in place, scaled to keep lengths; as many components as a power of two."""
    width, n = columns.shape
    step = 1
    while step < width:
        halves = columns.reshape(-1, 2, step, n)
        difference = halves[:, 0] - halves[:, 1]
        halves[:, 0] += halves[:, 1]
        halves[:, 1] = difference
        step *= 2
    columns *= np.float32(1 / np.sqrt(width))


def turned(columns: np.ndarray, table: int) -> np.ndarray:
    """The pseudo-rotation of a table, of vectors that stand in columns."""
    width = len(columns)
    signs = (np.random.default_rng((SEED, table)).integers(0, 2, (3, width, 1)) * 2 - 1).astype(np.float32)
    out = np.empty(columns.shape, np.float32)
    for at in range(0, columns.shape[1], COLUMNS_AT_A_TIME):
        part = columns[:, at : at + COLUMNS_AT_A_TIME] * signs[0]
        hadamard(part)
        for s in signs[1:]:
            part *= s
            hadamard(part)
        out[:, at : at + COLUMNS_AT_A_TIME] = part
    return out


def left_to_right(columns: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of each column with ``b``, summed in the order of the components."""
    # numpy adds the rows of an array one after the other
    return np.add.reduce(np.ascontiguousarray(columns) * b[:, None], axis=0)


def bands_of(lengths: np.ndarray, longest: float) -> np.ndarray:
    """The band of each length, 0 for the longest ones; lengths that differ by rounding from it are in band 0."""
    return np.floor(np.log(1.001 * longest / lengths) / np.log(BAND)).astype(np.int32)


class CrossPolytopeSearch:
    """The k nearest of a block of rows among those that the tables of each band bring, for each query of a block."""

    integer = False

    def __init__(self, k: int, longest: float):
        self.k, self.longest = k, longest

    def _units(self, grid: np.ndarray, even: bool, longest: float | None = None) -> np.ndarray:
        """Unit vectors, filled with zeros to a power of two. Rows of uneven length get one more axis that
        fills their length up to the ``longest`` one, so that angles order them by inner product."""
        length = np.linalg.norm(grid, axis=1, keepdims=True)
        if even:
            grid = grid / length
        elif longest:
            grid = grid / longest
            grid = np.column_stack([grid, np.sqrt(np.maximum(0, 1 - (grid**2).sum(axis=1)))])
        else:
            grid = np.column_stack([grid / length, np.zeros(len(grid))])
        width = 1 << (grid.shape[1] - 1).bit_length()
        return np.pad(grid, ((0, 0), (0, width - grid.shape[1])))

    def _brought(self, queries: np.ndarray, rows: np.ndarray, even: bool, longest: float) -> Iterator[np.ndarray]:
        """For each query the places of the rows of a band that are scored."""
        if len(rows) <= AT_LEAST:
            yield from [np.arange(len(rows))] * len(queries)
            return
        q, x = (np.ascontiguousarray(self._units(g, even, n).T, np.float32) for g, n in ((queries, None), (rows, longest)))
        width = len(x)
        probes = min(2 * width, max(1, PROBES * width // 64))
        lists, starts, sizes = [], [], []
        for t in range(TABLES):
            y, asked = turned(x, t), turned(q, t)
            axis = np.abs(y).argmax(axis=0)
            bucket = 2 * axis + (y[axis, np.arange(len(axis))] < 0)
            n = np.bincount(bucket, minlength=2 * width)
            near = np.stack([asked.T, -asked.T], axis=2).reshape(len(queries), -1)
            seen = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
            lists.append(np.argsort(bucket, kind="stable"))
            starts.append((np.cumsum(n) - n)[seen] + t * len(rows))
            sizes.append(n[seen])
        lists, starts, sizes = np.concatenate(lists), np.concatenate(starts, axis=1), np.concatenate(sizes, axis=1)
        for i in range(len(queries)):
            votes = np.bincount(ragged(lists, starts[i], sizes[i]), minlength=len(rows))
            yield np.flatnonzero(votes >= min(VOTES, np.partition(votes, -AT_LEAST)[-AT_LEAST]))

    def __call__(self, query_ids, queries, ids, rows):
        lengths, asked = np.linalg.norm(rows, axis=1), np.linalg.norm(queries, axis=1)
        bands = bands_of(lengths, self.longest)
        components = np.ascontiguousarray(rows.T)
        kept = [(np.empty(0, np.int64), np.empty(0))] * len(query_ids)
        for band in np.unique(bands):
            own = np.flatnonzero(bands == band)
            longest = lengths[own].max()
            reached = np.array([s[-1] if len(s) == self.k else -np.inf for _, s in kept])
            # with room for rounding; bands come with the longest rows first
            open_ = np.flatnonzero(longest * asked * (1 + 1e-9) >= reached)
            if not len(open_):
                break
            even = longest < 1.001 * lengths[own].min()
            for i, brought in zip(open_, self._brought(queries[open_], rows[own], even, longest), strict=True):
                found = own[brought]
                found = found[ids[found] != query_ids[i]]
                scores = np.append(kept[i][1], left_to_right(components[:, found], queries[i]))
                found = np.append(kept[i][0], found)
                top = leading(ids[found], scores, self.k)
                kept[i] = found[top], scores[top]
        return [
            np.concatenate([np.full(len(f), q) for q, (f, _) in zip(query_ids, kept, strict=True)]),
            np.concatenate([ids[f] for f, _ in kept]),
            np.concatenate([s for _, s in kept]),
        ]


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product found for each query.

    Queries are the rows whose vec_id ``every`` divides; no row with a query's own id is its candidate.
    Scores are sums of double products in the order of the components. Rows that repeat count as often
    as they occur, a repeated query is asked once; ties go to the smaller vec_id. Null ids, and vectors
    that are null, zero or hold null or non-finite components, take no part; shorter vectors count as
    if filled up with zeros. An empty table gives an empty result. Only vec_id and embedding are read.
    """
    rows = finite_vectors(embeddings).mapInArrow(_with_length, "vec_id long, v binary, length double")
    longest = rows.agg(F.max("length")).first()[0] or 1.0
    banded = rows.mapInArrow(_with_band(longest), "vec_id long, v binary, band int")
    return best(search_blocks(banded, every, CrossPolytopeSearch(k, longest), by="band"), k)


def _with_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pa.array([np.frombuffer(x).any() for x in batch.column("v").to_pylist()], pa.bool_()))
        yield batch.append_column("length", pa.array(np.linalg.norm(grid_of(batch.column("v")), axis=1)))


def _with_band(longest: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = bands_of(batch.column("length").to_numpy(), longest)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(bands)], names=["vec_id", "v", "band"])

    return work


@query("op6_nearest_neighbours")
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
