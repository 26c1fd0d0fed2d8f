"""Vectors for searches of a query set against all rows, met block by block.

Queries and rows are dealt into blocks of a fixed size; each pair of a query block and a row block is one
group. Work is queries times rows by definition of an exact search; a group's memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.sources.scratch import checkpoint

VECTORS = "vec_id long, v binary"
BLOCK = 4096


def finite_vectors(embeddings: DataFrame, change: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(vec_id, v) with v the components as doubles in bytes, all of one length, changed by ``change``.

    Left out: null ids, null vectors, and vectors that hold null or non-finite components. Vectors
    shorter than the longest one get zeros at the end, which leaves inner products as they are.
    """
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if vec_id is None or not x.is_valid or x.values.null_count:
                    continue
                x = x.values.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all():
                    ids.append(vec_id)
                    found.append(np.pad(x, (0, max(width, 0) - len(x))))
            grid = np.array(found, np.float64).reshape(len(ids), max(width, 0))
            grid = change(grid) if change else grid
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([x.tobytes() for x in grid], pa.binary())], names=["vec_id", "v"]
            )

    return checkpoint(rows.mapInArrow(work, VECTORS))


def grid_of(column: pa.ChunkedArray) -> np.ndarray:
    """The doubles of a binary column, one row each."""
    rows = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(rows, -1) if rows else np.empty((0, 0))


def packed(sizes: list[tuple[int, int]], block: int) -> list[tuple[int, int, int]]:
    """(value, first block, blocks) for (value, rows) in order: values in a row share a block as far as they fit."""
    found, next_, room = [], 0, 0
    for value, n in sizes:
        if n <= room:
            room -= n
            found.append((value, next_ - 1, 1))
            continue
        blocks = -(-n // block)
        found.append((value, next_, blocks))
        next_ += blocks
        room = block - n if blocks == 1 else 0
    return found


def search_blocks(rows: DataFrame, every: int, search: Callable, block: int = BLOCK, by: str | None = None) -> DataFrame:
    """Per pair of blocks what ``search(query ids, query grid, ids, grid)`` finds, as four columns.

    Queries are the ids that ``every`` divides, each once; an id that repeats with several vectors asks
    with the least one. ``search`` returns arrays (query_id, vec_id, score) of one block. With ``by``, an
    int column of few values, a block holds rows of one value or of neighbouring ones.
    """
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = checkpoint(asked)
    asked_blocks = max(1, -(-asked.count() // block))
    own = lambda df, n: df.withColumn("own", F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int"))
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if by:
        places = packed([tuple(r) for r in rows.groupBy(by).count().orderBy(by).collect()], block)
        row_blocks = max([1, *(first + blocks for _, first, blocks in places)])
        known = rows.sparkSession.createDataFrame(places, f"{by} int, first int, blocks int")
        salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).join(F.broadcast(known), by)
        dealt = salted.withColumn("own", F.expr("first + CAST(pmod(salt, blocks) AS INT)"))
    else:
        row_blocks = max(1, -(-rows.count() // block))
        dealt = own(rows, row_blocks)
    left = own(asked, asked_blocks).select("vec_id", "v", F.col("own").alias("asked"), every_of(row_blocks).alias("met"))
    right = dealt.select("vec_id", "v", every_of(asked_blocks).alias("asked"), F.col("own").alias("met"))
    kind = "long" if search.integer else "double"
    schema = f"query_id long, vec_id long, score {kind}"

    def work(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64 if search.integer else np.float64)]
        else:
            found = search(a["vec_id"].to_numpy(), grid_of(a["v"]), b["vec_id"].to_numpy(), grid_of(b["v"]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, found), strict=True)))

    return left.groupBy("asked", "met").cogroup(right.groupBy("asked", "met")).applyInArrow(work, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query over all blocks, ties to the smaller id: at most k rows came from a block."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def leading(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = -np.partition(-scores, k - 1)[k - 1]
        near = np.flatnonzero(scores >= edge)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]
