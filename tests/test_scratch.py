import os

from textmill.operators.components import connected_components
from textmill.sources.scratch import checkpoint, discard, shared_folder


def tables(spark):
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_a_finished_run_leaves_its_last_table_only(spark):
    before = tables(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    labels = connected_components(spark.range(41).withColumnRenamed("id", "node"), edges)
    assert {r["component"] for r in labels.collect()} == {0}
    assert len(tables(spark) - before) == 1


def test_only_own_tables_are_discarded(spark):
    before = tables(spark)
    written = checkpoint(spark.range(3))
    discard(spark.range(3), written)
    discard(written)
    assert tables(spark) == before
