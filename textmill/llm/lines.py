"""Substring deduplication by hashing lines and the sentences in them.

Units are lines, and the sentences of lines that hold several. Each is normalised (lower case, runs of
white space as one space) and hashed. Digests are grouped over the whole corpus; the occurrence in the
smallest document and there the first one stays, the others go. Offsets are those of the original text,
in code points, end exclusive. Units shorter than LEAST characters stay, as in the SQL of op2; with
``least_line`` lines have a bound of their own, and 1 takes every line that is not blank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import table
from textmill.llm.registry import query
from textmill.sources.scratch import checkpoint

LEAST = 50
_SENTENCE_END = re.compile(r"([.!?]\x20+)")
_SPACE = re.compile(r"[\x09-\x0D\x20]+")
UNITS = "doc_id long, version long, units array<struct<begin:int,end:int,one:long,two:long>>"


def units_of(text: str, least: int = LEAST, least_line: int | None = None) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised unit) of the lines of a text and the sentences of its longer lines.

    Units hold at least ``least`` characters, whole lines ``least_line`` if it is given.
    """
    least_line = max(1, least if least_line is None else least_line)
    at = 0
    for line in text.split("\n"):
        parts = _SENTENCE_END.sub("\\1\n", line).split("\n")
        begin = at
        for part in [line, *(parts if len(parts) > 1 else ())]:
            if part is line:
                start, end, bound = at, at + len(line), least_line
            else:
                start, end, bound = begin, begin + len(part), least
                begin = end
            if end - start >= bound:
                normal = _SPACE.sub(" ", part.lower()).strip(" ")
                if len(normal) >= bound:
                    yield start, end, normal
        at += len(line) + 1


def _digest(least: int, least_line: int | None):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            versions, counts, begins, ends, digests = [], [0], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                versions.append(xxhash.xxh3_64_intdigest(text.encode()) - (1 << 63))
                for begin, end, unit in units_of(text, least, least_line):
                    begins.append(begin)
                    ends.append(end)
                    digests.append(xxhash.xxh3_128_digest(unit.encode("utf-8", "surrogatepass")))
                counts.append(len(begins))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            units = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.StructArray.from_arrays(columns, ["begin", "end", "one", "two"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(versions, pa.int64()), units], names=["doc_id", "version", "units"])

    return work


def repeated_units(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, least_line: int | None = None) -> DataFrame:
    """(doc_id, version, spans) for every row: the stretches of its text that go, merged, in order.

    ``version`` is a hash of the text. Null and empty texts hold no units. Rows with a null id take no
    part. Repeated rows are one document and have the same spans; rows that share an id but not a text
    rank by their version. An empty table gives an empty result. Only the two columns are read.
    """
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    held = checkpoint(rows.mapInArrow(_digest(least, least_line), UNITS))
    units = held.filter("doc_id IS NOT NULL").select("doc_id", "version", F.explode("units").alias("u")).select("doc_id", "version", "u.*")
    place = F.struct("doc_id", "version", "begin", "end")
    # counted before the shuffle: a line that all documents hold is one row for each task
    earliest = units.groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    # a hot digest is on the large side of this join only, whose partitions Spark splits
    later = units.join(earliest.select("one", "two", "first"), ["one", "two"]).filter(place != F.col("first"))
    # a sentence may be a line elsewhere: the same place counts once
    spans = later.groupBy("doc_id", "version").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("found"))
    none = F.array().cast("array<struct<begin:int,end:int>>")
    merged = F.aggregate(
        "found",
        none,
        lambda a, s: F.when(
            (F.size(a) > 0) & (s["begin"] <= F.element_at(a, -1)["end"]),
            F.concat(
                F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(a, -1)["begin"].alias("begin"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(a, F.array(s))),
    )
    removed = spans.select(F.col("doc_id").alias("id"), F.col("version").alias("v"), merged.alias("spans"))
    on = (F.col("doc_id") == F.col("id")) & (F.col("version") == F.col("v"))
    return held.select("doc_id", "version").join(removed, on, "left").select("doc_id", "version", F.coalesce("spans", none).alias("spans"))


def without_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, least_line: int | None = None) -> DataFrame:
    """``documents`` without the repeated units, and with ``removed``: the original offsets of what went.

    Other columns pass through; a column ``removed`` of the input is replaced.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            versions = [xxhash.xxh3_64_intdigest((t or "").encode()) - (1 << 63) for t in batch.column("__text").to_pylist()]
            yield batch.append_column("__version", pa.array(versions, pa.int64()))

    kept = [c for c in documents.columns if c != "removed"]
    rows = documents.select(F.struct(*[f"`{c}`" for c in kept]).alias("__row"), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = rows.withColumn("__version", F.lit(0).cast("long")).schema
    spans = repeated_units(documents, doc_id, text, least, least_line).filter("size(spans) > 0").distinct()
    joined = rows.mapInArrow(work, schema).join(
        spans, (F.col(f"__row.`{doc_id}`") == F.col("doc_id")) & (F.col("__version") == F.col("version")), "left"
    )
    cut = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")),
        lambda a, s: F.struct(F.concat(a["kept"], F.substring(F.col("__text"), a["at"] + 1, s["begin"] - a["at"])).alias("kept"), s["end"].alias("at")),
        lambda a: F.concat(a["kept"], F.substring(F.col("__text"), a["at"] + 1, F.length("__text"))),
    )
    left = F.when(F.col("spans").isNotNull(), cut).otherwise(F.col("__text"))
    none = F.array().cast("array<struct<begin:int,end:int>>")
    columns = [left.alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in kept]
    return joined.select(*columns, F.coalesce("spans", none).alias("removed"))


_SQL = rf"""
    WITH lines AS (
      SELECT doc_id, all_lines[i] AS line, CAST(list_sum(list_transform(all_lines[1:i - 1], lambda x: length(x) + 1)) AS BIGINT) AS origin
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents) t,
        unnest(range(1, len(all_lines) + 1)) AS u(i)),
    split AS (
      SELECT doc_id, line, coalesce(origin, 0) AS origin, string_split(regexp_replace(line, '([.!?]\x20+)', '\1' || chr(10), 'g'), chr(10)) AS parts FROM lines),
    units AS (
      SELECT doc_id, origin AS b, origin + length(line) AS e, line AS unit FROM split
      UNION ALL
      SELECT doc_id, origin + coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))), 0), origin + list_sum(list_transform(parts[1:i], lambda x: length(x))), parts[i]
      FROM split, unnest(range(1, len(parts) + 1)) AS u(i) WHERE len(parts) > 1),
    normal AS (
      SELECT doc_id, b, e, trim(regexp_replace(lower(unit), '[\x09-\x0D\x20]+', ' ', 'g'), ' ') AS n FROM units),
    ranked AS (
      SELECT DISTINCT doc_id, b, e, row_number() OVER (PARTITION BY n ORDER BY doc_id, b, e) AS r FROM normal WHERE length(n) >= {LEAST}),
    gone AS (SELECT DISTINCT doc_id, b, e FROM ranked WHERE r > 1),
    reach AS (
      SELECT doc_id, b, e, max(e) OVER (PARTITION BY doc_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM gone),
    islands AS (
      SELECT doc_id, b, e, sum(CASE WHEN before IS NULL OR b > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY b, e) AS k FROM reach),
    spans AS (SELECT doc_id, CAST(min(b) AS BIGINT) AS b, CAST(max(e) AS BIGINT) AS e FROM islands GROUP BY doc_id, k),
    found AS (
      SELECT doc_id, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(e - b) AS BIGINT) AS n_removed, string_agg(b || ':' || e, ',' ORDER BY b) AS spans
      FROM spans GROUP BY doc_id)
    SELECT doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN found USING (doc_id)"""


@query("op2_line_dedup", _SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeated_units(table(spark, sf_dir, "documents"))
    shown = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["begin"].cast("string"), s["end"].cast("string"))))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return spans.select("doc_id", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), shown.alias("spans"))
