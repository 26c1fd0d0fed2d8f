"""Shared scratch space: checkpoints and intermediate files every executor can read."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="textmill-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one of our own in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_folder()
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing the table to the shared folder and reading it back.

    It survives the loss of executors like a reliable checkpoint, and the new plan starts from the
    table's real size. (A checkpointed plan keeps the estimates of its old joins, which multiply
    from round to round of an iteration, and could not tell a small table from a large one.)
    """
    spark = df.sparkSession
    path = new_path(spark, "stage")
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``checkpoint`` wrote, once nothing reads them any more; others are left alone."""
    for table in tables:
        path = getattr(table, "_scratch_path", None)
        if path:
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            table._scratch_path = None
