"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 20_000


def lookup_join(df: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join with a table that is unique on ``key``; any keys of ``df`` may be hot.

    Only one side repeats the key, so adaptive execution can split the partition of every hot key and
    give each part the one row it needs: nothing is counted first, and no number of hot keys is too
    many. For that the result has to be written, or aggregated on another key, not on this one.
    """
    values = [c for c in table.columns if c != key]
    return df.join(table.select(key, *values), key, how).select(*df.columns, *values)


def salted_pairs(
    left: DataFrame, right: DataFrame, key: str, sizes: DataFrame, condition, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Inner join, aliased a and b, of two tables that both repeat ``key``; heavy keys become a grid.

    ``sizes(key, n_left, n_right)`` holds the rows per key. Every key above ``rows_per_task`` is cut into
    left blocks times right blocks: each row keeps one random block of its own side and is repeated for
    the blocks of the other side, so every pair still meets exactly once and no task sees more than one
    block of each side. The numbers of blocks reach the rows by a join, however many keys are heavy.
    """
    a = _in_blocks(left, key, sizes, "n_left", "n_right", rows_per_task).alias("a")
    b = _in_blocks(right, key, sizes, "n_right", "n_left", rows_per_task).alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.__own") == F.col("b.__other")) & (F.col("a.__other") == F.col("b.__own"))
    return a.join(b, on & condition)


def _in_blocks(side: DataFrame, key: str, sizes: DataFrame, own: str, other: str, rows_per_task: int) -> DataFrame:
    """The rows with a block of their own side (__own), repeated for each block of the other one (__other)."""
    blocks = lambda n: F.greatest(F.ceil(F.coalesce(F.col(n), F.lit(1)) / rows_per_task), F.lit(1)).cast("int")
    heavy = sizes.filter((F.col(own) > rows_per_task) | (F.col(other) > rows_per_task))
    cut = lookup_join(side, heavy.select(key, blocks(own).alias("__rows"), blocks(other).alias("__cols")), key, "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    return (
        cut.withColumn("__own", F.pmod(F.xxhash64(*side.columns), one("__rows")).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), one("__cols") - 1)))
        .drop("__rows", "__cols")
    )


def self_sizes(df: DataFrame, key: str) -> DataFrame:
    """The ``sizes`` table of a join of ``df`` with itself."""
    return df.groupBy(key).agg(F.count("*").alias("n_left")).withColumn("n_right", F.col("n_left"))
