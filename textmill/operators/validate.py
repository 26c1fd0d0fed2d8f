"""Row rules. Every rule is judged on the unfiltered input, then all of them are combined."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import SPACE, is_blank, strip
from textmill.operators.columns import resolve
from textmill.options import Validation

# Accepted date layouts (ISO day, ISO day and time, six-part stamp with a zone name).
WEEKDAYS = "mon|tue|wed|thu|fri|sat|sun"
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
ISO_DAY = "yyyy-M-d"
ISO_SECOND = "yyyy-M-d H:m:s"
STAMP = "MMM d H:m:s yyyy"
STAMP_PATTERN = (
    rf"(?i)^(?:{WEEKDAYS})[{SPACE}]+({MONTHS})[{SPACE}]+([0-9]{{1,2}})[{SPACE}]+"
    rf"([0-9]{{1,2}}:[0-9]{{1,2}}:[0-9]{{1,2}})[{SPACE}]+[^{SPACE}]+[{SPACE}]+([0-9]{{4}})$"
)
METRIC = {
    "allowed_values": "invalid_polarity",
    "unique_id": "repeated_ids",
    "date": "wrong_date_format",
    "not_empty": "empty",
    "max_length": "too_long",
}


def has_allowed_value(c: Column, allowed: Sequence[int]) -> Column:
    """Digits that spell an allowed integer; NULL passes."""
    number = F.when(c.rlike(r"^[0-9]+\z"), c.try_cast("bigint"))
    return c.isNull() | F.coalesce(number.isin(*[int(a) for a in allowed]), F.lit(False))


def parse_date(c: Column) -> Column:
    """Timestamp of an accepted date string, NULL for anything else. The zone name is not read."""
    text = strip(c)
    part = lambda i: F.regexp_extract(text, STAMP_PATTERN, i)
    stamp = F.when(
        text.rlike(STAMP_PATTERN), F.concat_ws(" ", F.initcap(part(1)), part(2), part(3), part(4))
    )
    return F.coalesce(
        F.try_to_timestamp(c, F.lit(ISO_DAY)),
        F.try_to_timestamp(c, F.lit(ISO_SECOND)),
        F.try_to_timestamp(stamp, F.lit(STAMP)),
    )


def is_date(c: Column) -> Column:
    return parse_date(c).isNotNull()


def fits_length(c: Column, limit: int) -> Column:
    """Length in code points; NULL counts as three."""
    return F.length(F.coalesce(c, F.lit("nan"))) <= limit


def first_ids(df: DataFrame, column: str, row_idx: str, out: str) -> DataFrame:
    """Add ``out``: the row is the first one with its non-empty id.

    The first row per id is a partial aggregate, so a hot id costs one row per task, and it is
    joined back on the unique row number instead of on the id.
    """
    first = (
        df.filter(F.col(column).isNotNull() & (F.col(column) != ""))
        .groupBy(F.col(column))
        .agg(F.min(row_idx).alias(row_idx))
        .select(row_idx, F.lit(True).alias("__first"))
    )
    return (
        df.join(first, row_idx, "left").withColumn(out, F.coalesce("__first", F.lit(False))).drop("__first")
    )


def flag_rows(
    df: DataFrame,
    rules: Sequence[Validation],
    row_idx: str = "row_idx",
    mapping: Mapping[int, str] | None = None,
    lenient: bool = False,
) -> tuple[DataFrame, list[str], dict[str, list[Column]]]:
    """Add one boolean column per rule; also return their names and the columns that count failures."""
    data = [c for c in df.columns if c != row_idx]
    flags: list[str] = []
    failures: dict[str, list[Column]] = {}
    plain = {}
    for number, rule in enumerate(rules):
        name = resolve(data, rule.column, mapping, lenient)
        if name is None or (rule.kind == "allowed_values" and not rule.allowed):
            continue
        if rule.kind == "max_length" and not rule.max_length:
            continue
        c, flag = F.col(name), f"__rule{number}"
        counted = ~F.col(flag)
        if rule.kind == "allowed_values":
            plain[flag] = has_allowed_value(c, rule.allowed)
        elif rule.kind == "date":
            plain[flag] = is_date(c)
            counted = counted & c.isNotNull()
        elif rule.kind == "not_empty":
            plain[flag] = ~is_blank(c)
        elif rule.kind == "max_length":
            plain[flag] = fits_length(c, rule.max_length)
            counted = counted & c.isNotNull()
        elif rule.kind == "unique_id":
            df = first_ids(df, name, row_idx, flag)
            counted = counted & c.isNotNull() & (c != "")
        else:
            raise ValueError(f"unknown validation {rule.kind!r}")
        flags.append(flag)
        metric = f"{METRIC[rule.kind]}_{data.index(name)}"
        # like rules on one column add up
        failures.setdefault(metric, []).append(counted)
    return df.withColumns(plain) if plain else df, flags, failures


def validate(df: DataFrame, rules: Sequence[Validation], row_idx: str = "row_idx", **names) -> DataFrame:
    """Rows that satisfy every rule."""
    flagged, flags, _ = flag_rows(df, rules, row_idx, **names)
    if not flags:
        return df
    return flagged.filter(reduce(and_, (F.col(f) for f in flags))).select(*df.columns)


def count_failures(flagged: DataFrame, failures: Mapping[str, Sequence[Column]]) -> DataFrame:
    """(metric, n) with one row per metric, from one aggregate; failures of like rules add up."""
    counts = flagged.agg(
        F.array(
            *(
                F.struct(F.lit(m).alias("metric"), reduce(add, (F.count_if(c) for c in each)).alias("n"))
                for m, each in failures.items()
            )
        ).alias("m")
    )
    return counts.select(F.inline("m"))
