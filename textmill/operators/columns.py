"""Column references, projection by position and detection of text and target columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names the workflow knows.
KEEP_NAMES = ("target", "id", "date", "topic", "username", "tweet")
TEXT_NAMES = ("text", "tweet", "content", "message")
TARGET_NAMES = ("target", "polarity", "sentiment", "label")


def parse_keep(spec: str, allowed: Sequence[str] = KEEP_NAMES) -> dict[int, str]:
    """``"0:target, 5:tweet"`` as a mapping; malformed pairs and unknown names are left out."""
    pairs = (part.split(":") for part in spec.split(","))
    trimmed = ([s.strip() for s in pair] for pair in pairs if len(pair) == 2)
    return {int(i): name for i, name in trimmed if i.isdecimal() and name in allowed}


def resolve(
    data_columns: Sequence[str], ref: str | int, mapping: Mapping[int, str] | None = None, lenient: bool = False
) -> str | None:
    """Column name for a position, a mapped name or an own name; unknown ones raise unless lenient."""
    text = str(ref).strip()
    position = int(text) if text.lstrip("-").isdecimal() else None
    if position is None:
        position = next((i for i, name in (mapping or {}).items() if name == text), None)
        if position is None and text in data_columns:
            return text
    if position is not None and 0 <= position < len(data_columns):
        return data_columns[position]
    if lenient:
        return None
    raise ValueError(f"unknown column {ref!r}; have {list(data_columns)}")


def resolve_all(data_columns, refs, mapping=None, lenient=False) -> list[str]:
    names = (resolve(data_columns, r, mapping, lenient) for r in refs)
    return list(dict.fromkeys(n for n in names if n is not None))


def keep_columns(df: DataFrame, mapping: Mapping[int, str], row_idx: str | None = None) -> DataFrame:
    """Keep and rename columns by position; positions outside the table are ignored."""
    data = [c for c in df.columns if c != row_idx]
    kept = [F.col(f"`{data[i]}`").alias(mapping[i]) for i in sorted(mapping) if 0 <= i < len(data)]
    if not kept:
        return df
    return df.select(*([row_idx] if row_idx else []), *kept)


def _length(name: str, null_text: str) -> Column:
    return F.length(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(null_text)))


def mean_lengths(df: DataFrame, null_text: str = "nan") -> DataFrame:
    """(position, column, mean_length) of every column, from a single aggregate."""
    columns = df.columns
    means = df.agg(
        F.array(
            *(
                F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.avg(_length(c, null_text)).alias("mean_length"))
                for i, c in enumerate(columns)
            )
        ).alias("m")
    )
    return means.select(F.inline("m"))


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def detect_text_column(
    df: DataFrame, strategy: str = "longest", row_idx: str | None = None, sample_rows: int = 10
) -> DataFrame:
    """One-row table (position, column) with the detected text column.

    longest   largest mean length above 10, else the last column (labelling)
    name      a known name, else the first string column (training)
    name_long a known name, else the first string column with mean length above 20 (prediction)
    first     the first column after column 0 with mean length above 10, else the last (labelled data)
    sample    largest mean length above 10 in the first rows, else column 0 (manual labelling)
    """
    data = [c for c in df.columns if c != row_idx]
    spark = df.sparkSession
    fixed = lambda i: spark.range(1).select(F.lit(i).alias("position"), F.lit(data[i]).alias("column"))
    if strategy in ("name", "name_long"):
        known = next((c for c in TEXT_NAMES if c in data), None)
        strings = [c for c in string_columns(df) if c in data]
        if known is None and strategy == "name":
            known = strings[0] if strings else None
        if known is not None:
            return fixed(data.index(known))
        if not strings or strategy == "name":
            raise ValueError("no text column")
        long = mean_lengths(df.select(*data)).filter((F.col("mean_length") > 20) & F.col("column").isin(strings))
        return long.orderBy("position").limit(1).select("position", "column")
    if strategy == "sample":
        if row_idx is None:
            raise ValueError("the sample strategy needs the row_idx column")
        df = df.orderBy(row_idx).limit(sample_rows)
    default = 0 if strategy == "sample" else len(data) - 1
    found = mean_lengths(df.select(*data), "" if strategy == "sample" else "nan").filter("mean_length > 10")
    if strategy == "first":
        found = found.filter("position > 0").orderBy("position")
    else:
        found = found.orderBy(F.desc("mean_length"), "position")
    # at most two candidate rows: the match and the default
    candidates = found.select(F.lit(0).alias("rank"), "position", "column").limit(1).unionByName(
        fixed(default).select(F.lit(1).alias("rank"), "*")
    )
    return candidates.orderBy("rank").limit(1).select("position", "column")


def text_column(df: DataFrame, strategy: str = "longest", row_idx: str | None = None) -> str:
    """The name of the detected text column; an error where there is none."""
    found = detect_text_column(df, strategy, row_idx).first()
    if found is None:
        raise ValueError("no text column")
    return found["column"]


def detect_target_column(columns: Sequence[str], names: Sequence[str] = TARGET_NAMES) -> str | None:
    return next((c for c in names if c in columns), None)


def dataset_profile(df: DataFrame, row_idx: str = "row_idx") -> DataFrame:
    """One row: total_count, text_column_index and the text column's name."""
    total = df.agg(F.count("*")).scalar()
    return detect_text_column(df, "sample", row_idx).select(
        total.alias("total_count"), F.col("position").alias("text_column_index"), F.col("column").alias("text_column")
    )
