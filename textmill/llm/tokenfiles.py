"""Token-id files: encode texts, write their ids in the Simple-8b format in document order, read them back.

A file covers a run of documents in ascending order and is one binary value of the table that Spark
writes, beside the ids and lengths of its documents; so the files reach every store that Spark writes to
and a lost task is written again. ``shard`` and ``part`` give the order of the files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm import simple8b
from textmill.llm.chunks import pieces, worker_encoder
from textmill.llm.common import partitions, table
from textmill.llm.registry import query
from textmill.sources.scratch import new_path

END_ID = 0
FILE_BYTES = 8 << 20  # text of a file; longer texts have one of their own
FILES = "shard int, part int, n_ids long, keys array<long>, lengths array<long>, payload binary"


def write_token_files(documents: DataFrame, doc_id: str, text: str, tokenizer_path: str, out: str, added_tokens: bool = False) -> None:
    """Write the ids of all texts, each followed by END_ID, in ascending order of ``doc_id``.

    With ``added_tokens`` the tokenizer is left as its file defines it, so that an added token in a text
    becomes its id; without, special tokens are plain text.
    Null and empty texts hold END_ID only. Null keys come first; rows with equal keys are ordered by
    text. No other column is read. An empty table gives a table without files.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    dealt = (
        rows.repartitionByRange(partitions(spark), "key")
        .sortWithinPartitions("key", "text")
        .select("key", "text", F.spark_partition_id().alias("shard"))
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        encoder = worker_encoder(tokenizer_path, lambda: Tokenizer.from_file(tokenizer_path), added_tokens)
        part = 0
        for batch in pieces(batches, "text", FILE_BYTES):
            ids, counts = encoder.texts(batch.column("text"))
            ids = np.insert(ids, np.cumsum(counts), END_ID)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("shard")[0].as_py()], pa.int32()),
                    pa.array([part], pa.int32()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([batch.column("key").to_pylist()], pa.list_(pa.int64())),
                    pa.array([counts + 1], pa.list_(pa.int64())),
                    pa.array([simple8b.encode(ids)], pa.binary()),
                ],
                names=["shard", "part", "n_ids", "keys", "lengths", "payload"],
            )
            part += 1

    dealt.mapInArrow(work, FILES).write.option("compression", "zstd").parquet(out)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, all from the files.

    ``start`` counts the ids of all documents before; the offsets of the files are sums over one row for
    each file.
    """
    files = spark.read.schema(FILES).parquet(path)
    by_shard = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row for each partition
    over_all = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(over_all), F.lit(0)).alias("shard_start"))
    starts = files.select("shard", "part", F.coalesce(F.sum("n_ids").over(by_shard), F.lit(0)).alias("part_start"))
    starts = starts.join(shards, "shard").select("shard", "part", (F.col("shard_start") + F.col("part_start")).alias("file_start"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "part", "doc_id", "inside", "n_tokens", "ids_crc32"]
        for batch in batches:
            for i in range(batch.num_rows):
                ids = simple8b.decode(batch.column("payload")[i].as_py()).astype("<u4")
                lengths = np.asarray(batch.column("lengths")[i].as_py(), np.int64)
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(memoryview(ids[e - n : e]).cast("B")) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                shard, part = (pa.array([batch.column(c)[i].as_py()] * len(lengths), pa.int32()) for c in ("shard", "part"))
                keys = batch.column("keys")[i].values
                yield pa.RecordBatch.from_arrays(
                    [shard, part, keys, pa.array(ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())], names=names
                )

    schema = "shard int, part int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    read = files.select("shard", "part", "keys", "lengths", "payload").mapInArrow(work, schema)
    return read.join(starts, ["shard", "part"]).select(
        "doc_id", (F.col("file_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), path, added_tokens=True)
    return read_token_files(spark, path)
