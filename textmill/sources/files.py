"""Readers and writers for delimited text, charsets, keyword lists and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.text import strip
from textmill.sources.records import scan_records

DELIMITERS = (",", "|")


def read_csv(
    spark: SparkSession,
    path: str,
    header: bool = False,
    sep: str = ",",
    schema: T.StructType | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """All-string scan unless a schema is given; doubled quotes escape a quote.

    ``multi_line`` allows line breaks inside quotes and makes each file one task; ``records.scan_records`` reads
    them from splits of files.
    """
    reader = (
        spark.read.option("header", header)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    return (reader.schema(schema) if schema else reader).csv(path)


def with_row_idx(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Number the rows of a file scan 0, 1, 2, ... by file name and position.

    Rows of one split have consecutive generated ids, so the position inside the split is a
    difference, and the offset of each split comes from a small table with one row per split.
    """
    tagged = df.select(
        "*",
        F.struct(
            # parts of one job by their number, which may have more digits in later files
            F.regexp_extract("_metadata.file_path", r"part-(\d+)[^/]*$", 1).try_cast("bigint").alias("number"),
            F.col("_metadata.file_path"),
            F.col("_metadata.file_block_start"),
        ).alias("__split"),
        F.monotonically_increasing_id().alias("__id"),
    )
    splits = tagged.groupBy("__split").agg(F.count("*").alias("n"), F.min("__id").alias("first"))
    ordered = Window.orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "__split", (F.coalesce(F.sum("n").over(ordered), F.lit(0)) - F.col("first")).alias("__shift")
    )
    return tagged.join(offsets, "__split").select(
        (F.col("__id") + F.col("__shift")).alias(name), *[F.col(f"`{c}`") for c in df.columns]
    )


def choose_delimiter(spark: SparkSession, path: str) -> str:
    """Comma, unless the lines disagree on their comma count while bars are regular; one aggregate over all lines."""
    lines = spark.read.text(path)
    count = lambda sep: F.length("value") - F.length(F.replace("value", F.lit(sep), F.lit("")))
    stats = lines.agg(
        *(f(count(sep)).alias(f"{f.__name__}{i}") for i, sep in enumerate(DELIMITERS) for f in (F.min, F.max))
    ).first()
    commas_regular = stats["min0"] is not None and stats["min0"] == stats["max0"] > 0
    bars_regular = stats["min1"] is not None and stats["min1"] == stats["max1"] > 0
    return DELIMITERS[1] if bars_regular and not commas_regular else DELIMITERS[0]


def normalise_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(file, *columns): headerless records of any supported charset, parsed into string columns."""
    return scan_records(spark, path, columns)


def keyword_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-cased words of a comma-separated text file."""
    words = spark.read.text(path).select(F.explode(F.split("value", ",")).alias("word"))
    return words.select(F.lower(strip(F.col("word"))).alias("word")).filter("word <> ''").distinct()


def preview(df: DataFrame, n: int = 5, order: str = "row_idx") -> DataFrame:
    """The first rows in row order (planned as a bounded top-n per task)."""
    return df.orderBy(order).limit(n)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", header: bool = True) -> None:
    """Overwrite a stage table; delimited text only where another tool reads it."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", header).option("quote", '"').option("escape", '"').option(
            "ignoreLeadingWhiteSpace", False
        ).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        writer.format(fmt).save(path)
