"""Missing-value rules, applied in list order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.operators.columns import resolve_all
from textmill.options import MissingRule
from textmill.sources.scratch import checkpoint

QUANTILE_ACCURACY = 10_000


def drop_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(how="any", subset=list(columns))


def fill_constant(df: DataFrame, columns: Sequence[str], value: str | None = None) -> DataFrame:
    """Fill with a constant; a column whose type cannot hold it becomes a string column."""
    value = "" if value is None else value
    filled = {}
    for name in columns:
        c, kind = F.col(name), df.schema[name].dataType
        if isinstance(kind, T.NumericType) and _is_number(value):
            whole = isinstance(kind, T.IntegralType) and float(value) != int(float(value))
            target = T.DoubleType() if whole else kind
            filled[name] = F.coalesce(c.cast(target), F.lit(float(value)).cast(target))
        else:
            filled[name] = F.coalesce(c.cast("string"), F.lit(value))
    return df.withColumns(filled)


def _is_number(value: str) -> bool:
    try:
        return float(value) == float(value)
    except ValueError:
        return False


def _numeric(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric columns get their mean (one aggregate for all columns); the others stay as they are."""
    columns = _numeric(df, columns)
    if not columns:
        return df
    means = df.agg(F.struct(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)))).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), means[f"m{i}"]) for i, c in enumerate(columns)})


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median of each column that has values, found by narrowing intervals around the middle ranks.

    A round is one scan of a written copy of the columns with bounded partial aggregates for all open
    intervals: a quantile sketch of the values inside, then four counts. It shrinks an interval about
    a thousandfold. The values are never gathered or sorted anywhere.
    """
    values = checkpoint(df.select(*(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns))))
    sizes = values.agg(*(F.count(v).alias(v) for v in values.columns)).first()
    # (column, rank inside the interval, rows inside, lower and upper end, both exclusive)
    open_ = [
        [i, rank, sizes[i], None, None]
        for i in range(len(columns))
        for rank in sorted({(sizes[i] + 1) // 2, sizes[i] // 2 + 1})
        if sizes[i]
    ]
    found: dict[int, list[float]] = {}
    while open_:
        inside = []
        for i, _, _, low, high in open_:
            v = F.col(f"v{i}")
            inside.append(v.isNotNull() & (F.lit(True) if low is None else v > low) & (F.lit(True) if high is None else v < high))
        margin = 2.0 / QUANTILE_ACCURACY
        ends = lambda rank, size: [max(0.0, rank / size - margin), min(1.0, rank / size + margin)]
        sketches = values.agg(
            *(
                F.percentile_approx(F.when(has, F.col(f"v{x[0]}")), ends(x[1], x[2]), QUANTILE_ACCURACY)
                for x, has in zip(open_, inside, strict=True)
            )
        ).first()
        counts = []
        for (i, *_), has, (low, high) in zip(open_, inside, sketches, strict=True):
            v = F.col(f"v{i}")
            counts += [
                F.count_if(has & (v < low)), F.count_if(has & (v == low)),
                F.count_if(has & (v > low) & (v < high)), F.count_if(has & (v == high) & (v > low)),
            ]
        counted = values.agg(*(c.alias(str(k)) for k, c in enumerate(counts))).first()
        still = []
        for n, (i, rank, size, low, high) in enumerate(open_):
            below, at_low, between, at_high = counted[4 * n : 4 * n + 4]
            first, last = sketches[n]
            passed = below + at_low + between + at_high
            if rank <= below:
                still.append([i, rank, below, low, first])
            elif rank <= below + at_low:
                found.setdefault(i, []).append(first)
            elif rank <= below + at_low + between:
                still.append([i, rank - below - at_low, between, first, last])
            elif rank <= passed:
                found.setdefault(i, []).append(last)
            else:
                still.append([i, rank - passed, size - passed, last, high])
        open_ = still
    return {columns[i]: sum(found[i]) / len(found[i]) for i in found}


def exact_median(df: DataFrame, column: str) -> float | None:
    """Exact median of one column, None without values."""
    return exact_medians(df, [column]).get(column)


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric columns get their exact median."""
    columns = _numeric(df, columns)
    medians = exact_medians(df, columns) if columns else {}
    fills = {c: F.coalesce(F.col(c), F.lit(m)) for c, m in medians.items()}
    return df.withColumns(fills) if fills else df


def most_frequent(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Most frequent non-null value of each column, the smallest on a tie, as scalar subqueries of one scan.

    The cells of all columns are counted together, as (column number, value), each in a field of its own.
    """
    cells = [
        F.struct(F.lit(i).alias("i"), *(F.col(c).alias(f"v{k}") if k == i else F.lit(None).cast(df.schema[c].dataType).alias(f"v{k}") for k, c in enumerate(columns)))
        for i in range(len(columns))
    ]
    each = df.select(F.inline(F.array(*cells)))
    counts = each.groupBy(*each.columns).agg(F.count("*").alias("n"))
    best = checkpoint(
        counts.groupBy().agg(
            *(
                F.min_by(f"v{i}", F.when(F.col(f"v{i}").isNotNull(), F.struct(-F.col("n"), f"v{i}"))).alias(f"v{i}")
                for i in range(len(columns))
            )
        )
    )
    return [best.select(f"v{i}").scalar() for i in range(len(columns))]


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every column gets its most frequent value; a string column without values gets ''."""
    fills = {}
    for name, value in zip(columns, most_frequent(df, columns), strict=True):
        last = [F.lit("")] if isinstance(df.schema[name].dataType, T.StringType) else []
        fills[name] = F.coalesce(F.col(name), value, *last)
    return df.withColumns(fills) if fills else df


def apply_rules(
    df: DataFrame,
    rules: Sequence[MissingRule],
    row_idx: str | None = None,
    mapping: Mapping[int, str] | None = None,
    lenient: bool = False,
) -> DataFrame:
    data = [c for c in df.columns if c != row_idx]
    for rule in rules:
        columns = resolve_all(data, rule.columns, mapping, lenient) if rule.columns else data
        if not columns:
            continue
        if rule.strategy == "drop_rows":
            df = drop_rows(df, columns)
        elif rule.strategy == "fill_constant":
            df = fill_constant(df, columns, rule.constant)
        elif rule.strategy == "fill_mean":
            df = fill_mean(df, columns)
        elif rule.strategy == "fill_median":
            df = fill_median(df, columns)
        elif rule.strategy == "fill_mode":
            df = fill_mode(df, columns)
        else:
            raise ValueError(f"unknown strategy {rule.strategy!r}")
    return df
