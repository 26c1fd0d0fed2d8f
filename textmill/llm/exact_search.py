"""Exact top-k search by inner product with a table of pivot distances.

The distances of every vector to the pivots are computed once. By the triangle inequality each pivot
bounds the distance of a query and a row from below, hence their inner product from above; the best of
these bounds counts. Rows are scored in the order of their bounds, until no bound reaches the k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.blocks import best, finite_vectors, grid_of, leading, search_blocks
from textmill.llm.common import table
from textmill.llm.registry import query

SCALE = 1024
PIVOTS = 16
PIVOT_SAMPLE = 2000  # rows, least hashes first, from which the pivots are taken
FIRST_STEP = 256
LONG = 1 << 63


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` rows far from each other; the origin counts as the first pivot and is not listed."""
    chosen: list[np.ndarray] = []
    apart = np.linalg.norm(sample, axis=1)
    while len(chosen) < min(n, len(sample)) and apart.max() > 0:
        pivot = sample[int(apart.argmax())]
        chosen.append(pivot)
        apart = np.minimum(apart, np.linalg.norm(sample - pivot, axis=1))
    return np.array(chosen).reshape(len(chosen), sample.shape[1])


def with_distances(grid: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The components, then the distances to the origin and to the pivots."""
    with np.errstate(over="ignore", invalid="ignore"):
        far = [np.linalg.norm(grid, axis=1), *(np.linalg.norm(grid - p, axis=1) for p in pivots)]
    return np.column_stack([grid, *far])


class PivotSearch:
    """Top k of a block of rows for each query of a block; scores are exact integers."""

    integer = True

    def __init__(self, k: int, n_distances: int):
        self.k, self.n = k, n_distances
        self.scored = 0  # rows scored so far, for tests

    def __call__(self, query_ids, queries, ids, rows):
        width = queries.shape[1] - self.n
        q, x = queries[:, :width], rows[:, :width]
        to_q, to_x = queries[:, width:], rows[:, width:]
        reach = lambda a: float(np.abs(a).max()) if a.size else 0.0
        # doubles hold sums of products below 2**53 without error; larger ones are summed as Python integers
        exact = width * reach(q) * reach(x) < 2.0**53
        out: list[tuple[np.ndarray, ...]] = []
        for i in range(len(q)):
            if not exact:
                scores = np.array([max(-LONG, min(LONG - 1, sum(int(a) * int(b) for a, b in zip(q[i], y, strict=True)))) for y in x], dtype=object)
                scores = scores.astype(np.int64)
                others = np.flatnonzero(ids != query_ids[i])
                top = others[leading(ids[others], scores[others], self.k)]
                out.append((np.full(len(top), query_ids[i]), ids[top], scores[top]))
                continue
            apart = np.abs(to_x - to_q[i]).max(axis=1)
            squares = to_x[:, 0] ** 2 + to_q[i, 0] ** 2
            # room for rounding, so that no bound is below the score it bounds
            bound = (squares - apart**2) / 2 + 1e-9 * squares + 0.5
            bound[ids == query_ids[i]] = -np.inf
            order = np.argsort(-bound, kind="stable")[: int((ids != query_ids[i]).sum())]
            kept, scores = np.empty(0, np.int64), np.empty(0)
            at, step = 0, FIRST_STEP
            while at < len(order) and (len(kept) < self.k or bound[order[at]] >= scores[-1]):
                some = order[at : at + step]
                self.scored += len(some)
                kept, scores = np.append(kept, some), np.append(scores, x[some] @ q[i])
                top = leading(ids[kept], scores, self.k)
                kept, scores = kept[top], scores[top]
                at, step = at + step, step * 2
            out.append((np.full(len(kept), query_ids[i]), ids[kept], scores.astype(np.int64)))
        return [np.concatenate(c) for c in zip(*out, strict=True)]


def exact_top_k(embeddings: DataFrame, k: int = 10, every: int = 100, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest integer inner product for each query.

    Queries are the rows whose vec_id ``every`` divides; no row with a query's own id is its candidate,
    all other rows are. Components become floor(SCALE * x). Rows that repeat count as often as they
    occur, a repeated query is asked once; ties go to the smaller vec_id. Null ids, null vectors and
    vectors with null or non-finite components take no part; shorter vectors count as if filled up with
    zeros; scores beyond a long become its limits. An empty table gives an empty result. Only the
    columns vec_id and embedding are read.
    """
    rows = finite_vectors(embeddings, lambda grid: np.floor(SCALE * grid))
    sample = rows.orderBy(F.xxhash64("v"), "vec_id").limit(PIVOT_SAMPLE).toArrow()
    chosen = choose_pivots(grid_of(sample["v"]), pivots) if sample.num_rows else np.empty((0, 0))
    measured = rows.mapInArrow(_measure(chosen), "vec_id long, v binary")
    return best(search_blocks(measured, every, PivotSearch(k, 1 + len(chosen))), k)


def _measure(pivots: np.ndarray):
    def work(batches):
        for batch in batches:
            grid = with_distances(grid_of(batch.column(1)), pivots) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in grid], pa.binary())], names=["vec_id", "v"])

    return work


_SQL = """
    WITH rows AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (
      SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
        CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
      FROM rows q JOIN rows x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
    FROM scores QUALIFY rank <= 10"""


@query("op1_exact_top_k", _SQL)
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))
