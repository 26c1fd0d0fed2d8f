import random
import re

import pytest
from pyspark.sql import functions as F

from textmill.llm import mixing


def brute_targets(sizes):
    """Targets by raising one source after the other to its ceiling."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 3 * sizes[s]]
        if not over:
            return {s: 3 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped.update(over)


def documents(rng):
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, "é", "Z"]), " ".join(["w"] * rng.randint(0, 40))) for i in range(600)]
    return [*rows, (600, "tiny", "one word \t two\n"), (601, "none", ""), (602, "none", None), (None, "b", "x y"), (7, "b", "x y"), (7, "b", "x y")]


def run(spark, rows):
    df = spark.createDataFrame([(i, s, t, 5) for i, s, t in rows], "doc_id long, source string, text string, size int")
    sized = df.select(F.struct("doc_id", "source", "size").alias("row"), "source", mixing.n_words("text").alias("size"), F.col("doc_id").alias("tie"))
    return df, mixing.systematic_copies(sized).collect()


def test_targets_and_copies(spark):
    rows = documents(random.Random(5))
    df, found = run(spark, rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        assert 0 <= r.copies <= 3 and r.source_size == sizes[r.row.source]
        assert r.target == pytest.approx(want[r.row.source])
        taken[r.row.source] = taken.get(r.row.source, 0) + r.copies * r["size"]
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s, n in taken.items():
        assert abs(n - want[s]) <= 41
    assert taken["tiny"] == 3 * sizes["tiny"] == 6 and taken["none"] == 0
    # a rerun agrees, and the mix holds each row as often as it was taken
    again = run(spark, rows)[1]
    assert sorted(map(str, again)) == sorted(map(str, found))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in found)


def test_one_source_empty_table_and_equal_rows(spark):
    rows = [(1, "s", "a b")] * 5 + [(2, "s", None)]
    _, found = run(spark, rows)
    assert [r.target for r in found] == [10.0] * 6 and sum(r.copies * r["size"] for r in found) == 10
    assert run(spark, rows[:0] or [(1, None, None)])[1][0].target == 0
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(empty).collect() == []
