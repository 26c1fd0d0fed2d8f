"""Set similarity: distance tables and near-pair search without comparing all pairs.

Rows with equal token sets are collapsed first, so a mass of copies counts as one set. Candidate
pairs then come from the rare end of each set only (prefix filtering), which is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.tokens import jaccard_distance, word_set
from textmill.operators.blocks import both_sides, in_order, overlaps, pairs_in_blocks, shared_tiles, sharing_rows
from textmill.operators.skew import lookup_join, salted_pairs, self_sizes
from textmill.sources.scratch import checkpoint, discard

SLACK = 1e-9


def row_sets(df: DataFrame, text: str, row_idx: str = "row_idx", *keep: str) -> DataFrame:
    """(row_idx, set_key, words): a text without words is the set holding the empty string."""
    tokens = word_set(F.col(text))
    filled = F.when(F.size(tokens) == 0, F.array(F.lit(""))).otherwise(F.array_sort(tokens))
    sets = df.select(row_idx, *keep, filled.alias("words"))
    return sets.withColumn("set_key", F.sha2(F.array_join("words", " "), 256))


def distinct_sets(rows: DataFrame, row_idx: str = "row_idx") -> DataFrame:
    """(set_key, gid, copies, size, words) with gid the first row of each distinct set."""
    grouped = rows.groupBy("set_key").agg(
        F.min(row_idx).alias("gid"), F.count("*").alias("copies"), F.first("words").alias("words")
    )
    return grouped.withColumn("size", F.size("words"))


def set_members(df: DataFrame, text: str, row_idx: str = "row_idx") -> DataFrame:
    """(row_idx, gid): which distinct set a row belongs to."""
    rows = row_sets(df, text, row_idx)
    groups = rows.groupBy("set_key").agg(F.min(row_idx).alias("gid"))
    return lookup_join(rows.select(row_idx, "set_key"), groups, "set_key").select(row_idx, "gid")


def token_frequencies(sets: DataFrame) -> DataFrame:
    """(tok, n): in how many sets a token occurs."""
    return sets.select(F.explode("words").alias("tok")).groupBy("tok").agg(F.count("*").alias("n"))


def ranked_tokens(sets: DataFrame, frequencies: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """(gid, size, tok, n, pos) with the rarest token of each set at position 1; unknown ones count 0.

    Further columns of ``frequencies`` (a number for each token, say) come along.
    """
    exploded = sets.select("gid", "size", F.explode("words").alias("tok"))
    known = lookup_join(exploded, frequencies, "tok", "left" if keep_unknown else "inner")
    rarest_first = Window.partitionBy("gid").orderBy("n", "tok")
    return known.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("pos", F.row_number().over(rarest_first))


def word_ids(sets: DataFrame, key: str) -> DataFrame:
    """(key, ids): the words of each set by number, ascending; the rarest word has the smallest."""
    numbers = in_order(token_frequencies(sets), "n", "tok").select("tok", "id")
    placed = lookup_join(sets.select(key, F.explode("words").alias("tok")), numbers, "tok")
    return placed.groupBy(key).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def near_sets(sets: DataFrame, max_distance: float) -> DataFrame:
    """(i, j, distance, copies_i, copies_j) of distinct sets within ``max_distance`` (below 1), with i < j.

    Words are numbered, the rarest first. Blocks of sets meet in tasks of bounded size, which count the words that two
    prefixes share: what is missing to the overlap that the distance asks for has to fit into what is left behind the
    shorter prefix. The task compares pairs that pass in full, and only near pairs leave it.
    """
    if not 0 <= max_distance < 1:
        raise ValueError("max_distance must be in [0, 1); all other pairs lie at a distance above it")
    need = 1.0 - max_distance
    known = sets.filter("gid IS NOT NULL").select("gid", "copies", "size", "words", F.monotonically_increasing_id().alias("set"))
    held = checkpoint(known)
    length = (F.col("size") - F.ceil(need * F.col("size") - SLACK) + 1).cast("int").alias("length")
    sent = checkpoint(held.select("set", "gid", "copies", "size", length).join(word_ids(held, "set"), "set").drop("set"))
    discard(held)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_a, all_b = both_sides(batches, "ids")
        a = all_a.heads(all_a.column("length").astype(np.int64))
        b = a if all_a is all_b else all_b.heads(all_b.column("length").astype(np.int64))
        size_a, size_b = a.column("size"), b.column("size")
        (gid_a, copies_a), (gid_b, copies_b) = ([x.table[c].combine_chunks() for c in ("gid", "copies")] for x in (a, b))
        last_a, last_b = (x.items[x.ends - 1] for x in (a, b))  # no prefix is empty
        for i, j, shared in sharing_rows(a, b):
            x, y = size_a[i], size_b[j]
            least = np.ceil(need / (1 + need) * (x + y) - SLACK)
            rest = np.where(last_a[i] <= last_b[j], x - a.counts[i], y - b.counts[j])
            near = np.flatnonzero((np.minimum(x, y) >= need * np.maximum(x, y) - SLACK) & (shared + rest >= least))
            common = overlaps(all_a, all_b, i[near], j[near])
            distance = 1.0 - common / (x[near] + y[near] - common)
            near, distance = (v[distance <= max_distance + SLACK] for v in (near, distance))
            yield _named(gid_a, copies_a, i[near], gid_b, copies_b, j[near], distance)

    schema = _pair_schema(sets)
    return pairs_in_blocks(sent, "size", "ids", work, schema, lambda large, small: large >= need * small - SLACK)


def _pair_schema(sets: DataFrame) -> str:
    kind = sets.schema["gid"].dataType.simpleString()
    return f"i {kind}, j {kind}, distance double, copies_i long, copies_j long"


def _named(gid_a, copies_a, i: np.ndarray, gid_b, copies_b, j: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    """Pairs of rows by the numbers of their first rows, the smaller one first; two sets of one number are no pair."""
    i, j = pa.array(i, pa.int64()), pa.array(j, pa.int64())
    one, two, n, m = gid_a.take(i), gid_b.take(j), copies_a.take(i), copies_b.take(j)
    in_place = pc.less(one, two)
    sides = [pc.if_else(in_place, x, y) for x, y in ((one, two), (two, one), (n, m), (m, n))]
    columns = [*sides[:2], pa.array(distance, pa.float64()), *sides[2:]]
    return pa.RecordBatch.from_arrays(columns, names=["i", "j", "distance", "copies_i", "copies_j"]).filter(pc.not_equal(one, two))


def near_pairs(df: DataFrame, text: str, max_distance: float, row_idx: str = "row_idx") -> DataFrame:
    """(i, j, distance, copies_i, copies_j): near pairs of distinct sets, each with its row count.

    Rows with the same set lie at distance 0 of each other and share every pair of their set;
    ``set_members`` lists them.
    """
    return near_sets(distinct_sets(row_sets(df, text, row_idx), row_idx), max_distance)


def all_pairs(df: DataFrame, text: str, row_idx: str = "row_idx") -> DataFrame:
    """(i, j, distance, copies_i, copies_j): every pair of distinct sets, those without a common word too, with i < j.

    A set with several rows is paired with itself, too: its rows lie at distance 0 of each other. So all pairs of rows are stood for.
    Blocks of sets meet in tasks, which send pairs on as they are counted: as many rows as there are pairs.
    """
    sets = distinct_sets(row_sets(df, text, row_idx), row_idx).filter("gid IS NOT NULL")
    held = checkpoint(sets.select("gid", "copies", "size", "words", F.monotonically_increasing_id().alias("set")))
    compact = checkpoint(held.select("set", "gid", "copies", "size").join(word_ids(held, "set"), "set"))
    discard(held)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = both_sides(batches, "ids")
        (gid_a, copies_a), (gid_b, copies_b) = ([x.table[c].combine_chunks() for c in ("gid", "copies")] for x in (a, b))
        size_a, size_b = a.column("size"), b.column("size")
        for rows, others, shared in shared_tiles(a, b):
            if a is b and rows.start >= others.stop:
                continue
            i, j = np.indices(shared.shape).reshape(2, -1)
            i, j = i + rows.start, j + others.start
            common = shared.reshape(-1).astype(np.float64)
            if a is b:
                once = i < j
                i, j, common = i[once], j[once], common[once]
            distance = 1.0 - common / (size_a[i] + size_b[j] - common)
            yield _named(gid_a, copies_a, i, gid_b, copies_b, j, distance)

    found = pairs_in_blocks(compact, "size", "ids", work, _pair_schema(sets), lambda large, small: F.lit(True), some=8)
    repeated = compact.filter("copies > 1").select(
        F.col("gid").alias("i"), F.col("gid").alias("j"), F.lit(0.0).alias("distance"), F.col("copies").alias("copies_i"), F.col("copies").alias("copies_j")
    )
    return found.unionByName(repeated)


def pairwise_distances(
    df: DataFrame,
    pairs: DataFrame,
    text: str,
    method: Callable[[Column, Column], Column] = jaccard_distance,
    row_idx: str = "row_idx",
) -> DataFrame:
    """Add ``distance`` to a table of (i, j) row pairs, with any Column function as the distance."""
    a = df.select(F.col(row_idx).alias("i"), F.col(text).alias("__a"))
    b = df.select(F.col(row_idx).alias("j"), F.col(text).alias("__b"))
    both = pairs.join(a, "i").join(b, "j")
    return both.select(*pairs.columns, method(F.col("__a"), F.col("__b")).alias("distance"))


def overlapping_sets(sets: DataFrame) -> DataFrame:
    """(i, j, similarity) of all distinct sets that share a token, by counting shared tokens.

    This is the sparse form of the full distance matrix: a missing pair lies at distance 1. Frequent
    tokens are cut into salted blocks and the pair counts are combined before the shuffle.
    """
    tokens = sets.select("gid", "size", F.explode("words").alias("tok"))
    paired = salted_pairs(tokens, tokens, "tok", self_sizes(tokens, "tok"), F.col("a.gid") < F.col("b.gid"))
    shared = paired.groupBy(
        F.col("a.gid").alias("i"), F.col("b.gid").alias("j"), (F.col("a.size") + F.col("b.size")).alias("total")
    ).agg(F.count("*").alias("n"))
    return shared.select("i", "j", (F.col("n") / (F.col("total") - F.col("n"))).alias("similarity"))
