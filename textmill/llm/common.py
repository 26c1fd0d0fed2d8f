"""Helpers shared by the operators: whole rows as structs, positions within ordered groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.sources.scratch import checkpoint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with the position (from 1) of each row in its group by ``order``; groups hold no nulls.

    The rows are dealt out by ranges of (groups, order), so a group of any size spreads over many
    partitions. Positions inside a partition are counted there; the offsets are sums over one row
    for each (group, partition). Rows equal in all these columns get their positions in any order.
    """
    spark = df.sparkSession
    dealt = checkpoint(
        df.repartitionByRange(partitions(spark), *groups, *order).withColumn("__part", F.spark_partition_id())
    )
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*groups, "__part")
        .agg(F.count("*").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy(*groups, "__part").orderBy(*order)
    return (
        dealt.withColumn("__inside", F.row_number().over(inside))
        .join(offsets, [*groups, "__part"])
        .withColumn(out, F.col("__before") + F.col("__inside"))
        .drop("__part", "__inside", "__before")
    )
