"""Whole-row duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remove_duplicates(df: DataFrame, row_idx: str = "row_idx", copies: str | None = None) -> DataFrame:
    """Keep the first of equal rows (NULLs equal). Copies collapse inside each task before the shuffle."""
    data = [c for c in df.columns if c != row_idx]
    kept = df.groupBy(*data).agg(F.min(row_idx).alias(row_idx), F.count("*").alias(copies or "__copies"))
    return kept.select(*df.columns, *([copies] if copies else []))
