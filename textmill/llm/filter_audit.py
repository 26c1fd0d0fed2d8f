"""Filter interaction audit: how filters overlap, for every order in which they could be applied.

Each document is reduced to the set of filters that it fails. What is counted are cells: documents by part and
set, 32 sets for five filters. A walk over all subsets of filters in Gray code order toggles one filter at a
time; each cell keeps how many of the active filters it fails, and the survivors change by the cells whose number
leaves or reaches zero. The survivors of each subset are stored, so every step of every order is a difference of two
of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import table
from textmill.llm.registry import query

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WHITE = r"[\x20\x09-\x0D]+"
MEASURES = ("n", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def survivors(cells: np.ndarray) -> np.ndarray:
    """The totals of the cells that survive each subset of filters; (2^k, measures) each, by bit masks."""
    masks = np.arange(len(cells))
    out = np.zeros_like(cells)
    failures = np.zeros(len(cells), np.int64)  # active filters that each cell fails
    running = cells.sum(axis=0)
    out[0] = running
    state = 0
    for step in range(1, len(cells)):
        toggled = step & -step  # in Gray code order, the lowest bit of the step's number
        state ^= toggled
        failing = (masks & toggled) != 0
        if state & toggled:
            running = running - cells[failing & (failures == 0)].sum(axis=0)
            failures[failing] += 1
        else:
            failures[failing] -= 1
            running = running + cells[failing & (failures == 0)].sum(axis=0)
        out[state] = running
    return out


def audit_rows(cells: np.ndarray, letters: str) -> list[tuple]:
    """(order, step, *COUNTS) for every order of the filters and every step of it."""
    k, states = len(letters), survivors(cells)
    everything = len(cells) - 1
    fails = [int(cells[(np.arange(len(cells)) >> f & 1) == 1, 0].sum()) for f in range(k)]
    unique = [int(states[everything & ~(1 << f), 0] - states[everything, 0]) for f in range(k)]
    rows, shapley = [], [0] * k
    for order in permutations(range(k)):
        state = 0
        for step, f in enumerate(order, 1):
            before, state = states[state], state | 1 << f
            lost = [int(x) for x in before - states[state]]
            shapley[f] += lost[0]
            rows.append((order, step, f, int(states[state, 0]), lost[0], fails[f] - lost[0], unique[f], lost[1], lost[2]))
    name = lambda order: "".join(letters[f] for f in order)
    return [(name(order), step, *counts, shapley[f]) for order, step, f, *counts in rows]


def failure_cells(documents: DataFrame, labels: DataFrame, failures: dict[str, Column], same: str, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the set of filters they fail.

    ``failures`` are conditions on a row, bit by bit in their order; the last bit, ``same``, is that a smaller doc_id
    has an identical text in the whole table. Null texts are empty, null parts the empty string. Rows that repeat a
    doc_id count each. A row with a null doc_id has no smaller one, is no one's smaller one and has no labels.
    Of repeated labels the highest count. Conditions that are null do not fail.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # texts are read once and go no further: a digest and the mask of the other filters stand for them
    mask = sum((F.when(failing, 1 << bit).otherwise(0) for bit, failing in enumerate(failures.values())), F.lit(0))
    rows = documents.select(F.col("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    total = lambda c: F.sum(c).alias(c)
    # repeated rows first, so that the least id of a group has all its rows in one
    by_id = rows.filter("doc_id IS NOT NULL").groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    times = lambda c, out: F.when(F.col(c), F.col("n")).otherwise(0).alias(out)
    by_id = by_id.join(known, "doc_id", "left").select("doc_id", "part", "digest", "mask", "n", times("is_good", "good"), times("is_toxic", "toxic"))
    first = F.min(F.struct("doc_id", *MEASURES)).alias("first")
    groups = by_id.groupBy("digest", "part", "mask").agg(*map(total, MEASURES), first)
    # a text has one row for each part and mask now, however many copies it has
    least = groups.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    groups = groups.join(least, "digest")
    stays = F.col("first.doc_id") == F.col("least")
    bit = 1 << len(failures)
    assert same not in failures
    unique = groups.filter(stays).select("part", "mask", *[F.col(f"first.{m}").alias(m) for m in MEASURES])
    copies = groups.select(
        "part", (F.col("mask") + bit).alias("mask"), *[(F.col(m) - F.when(stays, F.col(f"first.{m}")).otherwise(0)).alias(m) for m in MEASURES]
    )
    none = F.lit(0).cast("long")
    without_id = rows.filter("doc_id IS NULL").select("part", "mask", F.lit(1).cast("long").alias("n"), none.alias("good"), none.alias("toxic"))
    return unique.union(copies).union(without_id).groupBy("part", "mask").agg(*map(total, MEASURES))


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each
    part of ``cells(part, mask, n, good, toxic)``, every order of the filters and every step.

    The counts of a step: kept after it, removed by it; failing its filter but removed before; failing its filter
    only; removed good and toxic ones; and what its filter removes, summed over all orders. No cells, no rows.
    """
    size = 1 << len(letters)
    # at most 2^k cells for each part
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals = np.zeros((size, len(MEASURES)), np.int64)
                for c in own:
                    totals[c["mask"]] += [c[m] for m in MEASURES]
                order, step, *counts = zip(*audit_rows(totals, letters), strict=True)
                columns = [pa.array([name] * len(step), pa.string()), pa.array(order, pa.string()), pa.array(step, pa.int32())]
                columns += [pa.array(c, pa.int64()) for c in counts]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *COUNTS])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return parts.mapInArrow(work, schema)


def five_filters() -> dict[str, Column]:
    """A: under 100 words; B: under 80 % distinct words; C: over 10 % capitals; D: holds one of `#$%&*|`."""
    text = F.col("text")
    words = F.array_remove(F.split(text, WHITE), "")
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _sql() -> str:
    """By definition: each document's conditions, then sums over the cells of each part, order and step."""
    return rf"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
        firsts AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
        known AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
        docs AS (SELECT w.part,
            (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END)
            + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
            + (CASE WHEN 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * length(w.text) THEN 4 ELSE 0 END)
            + (CASE WHEN regexp_matches(w.text, '[#$%&*|]') THEN 8 ELSE 0 END)
            + (CASE WHEN w.doc_id > f.first THEN 16 ELSE 0 END) AS mask,
            coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
          FROM w JOIN firsts AS f ON w.text = f.text LEFT JOIN known USING (doc_id)),
        cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY part, mask),
        f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
          FROM f AS a, f AS b, f AS c, f AS d, f AS e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        steps AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS earlier
          FROM orders, range(1, 6) AS r(step)),
        counted AS (SELECT part, filter_order, step, bit,
            sum(CASE WHEN mask & CAST(earlier + bit AS BIGINT) = 0 THEN n ELSE 0 END) AS kept,
            sum(CASE WHEN mask & bit <> 0 AND mask & CAST(earlier AS BIGINT) = 0 THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN mask & bit <> 0 AND mask & CAST(earlier AS BIGINT) <> 0 THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN mask & bit <> 0 AND mask & CAST(earlier AS BIGINT) = 0 THEN good ELSE 0 END) AS good_lost,
            sum(CASE WHEN mask & bit <> 0 AND mask & CAST(earlier AS BIGINT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
          FROM steps, cells GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
          CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
          CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM counted"""


@query("op11_filter_audit", _sql())
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    cells = failure_cells(documents, table(spark, sf_dir, "labels"), five_filters(), "E")
    return audit(cells, "ABCDE")
