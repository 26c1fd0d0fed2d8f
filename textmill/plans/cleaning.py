"""The cleaning run: validations, duplicates, text, missing values, kept columns, and its metrics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.language import by_function_words
from textmill.functions.text import clean_text, is_blank
from textmill.operators.columns import keep_columns, resolve_all
from textmill.operators.dedup import remove_duplicates
from textmill.operators.missing import apply_rules
from textmill.operators.validate import flag_rows
from textmill.options import CleaningOptions, TextOptions
from textmill.sources.scratch import checkpoint

# Names of the row counters.
ROW_METRICS = (
    "initial_rows",
    "rows_removed_validation",
    "duplicate_rows",
    "rows_removed_empty_text",
    "rows_dropped_missing",
    "final_rows",
    "rows_removed",
)


@dataclass(frozen=True)
class CleanResult:
    data: DataFrame
    row_metrics: DataFrame
    reason_metrics: DataFrame


def clean_columns(df: DataFrame, options: TextOptions, names: list[str], detect=by_function_words) -> DataFrame:
    """Clean every named column in place; add ``__reason_<i>`` per column and ``__blank`` per row."""
    for i, name in enumerate(names):
        df = clean_text(df, name, options, out=f"__out_{i}", reason=f"__reason_{i}", detect=detect)
        df = df.withColumn(name, F.col(f"__out_{i}")).drop(f"__out_{i}")
    return df.withColumn("__blank", reduce(and_, (is_blank(F.col(n)) for n in names)))


def drop_empty_text(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop rows whose chosen text columns are all blank."""
    return df.filter(~reduce(and_, (is_blank(F.col(n)) for n in names)))


def clean(df: DataFrame, options: CleaningOptions, row_idx: str = "row_idx", detect=by_function_words) -> CleanResult:
    """Run all steps in their fixed order.

    The rows are judged once, and what became of them is written to the shared folder: rows that fail a rule as their
    failures only, equal rows as one with its number of copies, with the reasons of the text steps. The cleaned rows
    and all metrics are read from that table. ``detect`` tells the language filter a text's language (``clean_text``).
    """
    data = [c for c in df.columns if c != row_idx]
    flagged, flags, failures = flag_rows(df, options.validations, row_idx, options.keep, options.lenient)
    passed = reduce(and_, (F.col(f) for f in flags)) if flags else F.lit(True)
    failed = [f"__failed_{k}" for k in range(len(failures))]
    number = lambda tests: reduce(add, (F.when(t, 1).otherwise(0) for t in tests))
    marked = flagged.select(
        row_idx, passed.alias("__passed"), *[F.when(passed, F.col(c)).alias(c) for c in data],
        *[number(tests).alias(name) for name, tests in zip(failed, failures.values())],
    )
    if options.remove_duplicates:
        marked = remove_duplicates(marked, row_idx, copies="__copies")
    else:
        marked = marked.withColumn("__copies", F.lit(1).cast("bigint"))

    names = resolve_all(data, options.text.columns, options.keep, options.lenient) if options.text else []
    if names:
        marked = clean_columns(marked, options.text, names, detect)
    else:
        marked = marked.withColumn("__blank", F.lit(False))
    judged = checkpoint(marked)
    textual = judged.filter("__passed AND NOT __blank").select(*df.columns)
    filled = apply_rules(textual, options.missing, row_idx, options.keep, options.lenient)
    final = keep_columns(filled, options.keep, row_idx) if options.keep else filled

    c = F.col
    total = lambda value: F.coalesce(F.sum(value), F.lit(0)).cast("bigint")
    counts = judged.agg(
        total("__copies").alias("initial"), total(F.when(c("__passed"), c("__copies"))).alias("valid"),
        F.count_if("__passed").alias("unique"), F.count_if(c("__passed") & ~c("__blank")).alias("textual"),
    )
    drops = any(rule.strategy == "drop_rows" for rule in options.missing)
    counts = counts.withColumn("final", filled.agg(F.count("*")).scalar() if drops else c("textual"))
    values = (
        c("initial"), c("initial") - c("valid"), c("valid") - c("unique"), c("unique") - c("textual"),
        c("textual") - c("final"), c("final"), c("initial") - c("final"),
    )
    row_metrics = counts.select(
        F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("n")) for m, v in zip(ROW_METRICS, values))))
    )

    reasons = df.sparkSession.createDataFrame([], "metric string, n bigint")
    if names:
        why = F.explode(F.array(*(c(f"__reason_{i}") for i in range(len(names)))))
        each = judged.filter("__passed").select(why.alias("metric"))
        reasons = each.filter(c("metric").isNotNull()).groupBy("metric").agg(F.count("*").alias("n"))
    if failures:
        per_rule = judged.agg(*(total(c(f) * c("__copies")).alias(f) for f in failed))
        per_rule = per_rule.select(F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), c(f).alias("n")) for m, f in zip(failures, failed)))))
        reasons = per_rule.filter("n > 0").unionByName(reasons)
    return CleanResult(final, row_metrics, reasons)
