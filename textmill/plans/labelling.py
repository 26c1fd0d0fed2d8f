"""Labelling runs: detect the text, label by hand, keywords or clusters, and sum the result up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators import clustering
from textmill.operators.columns import text_column
from textmill.operators.labelling import label_by_keyword_tables, label_by_keywords, label_clusters, label_manual, label_summary
from textmill.sources.scratch import checkpoint

PREVIEW_ROWS = 50
CLUSTERINGS = {
    "kmeans": clustering.kmeans,
    "agglomerative": clustering.agglomerative,
    "dbscan": clustering.dbscan,
    "hierarchical": clustering.hierarchical,
}


@dataclass(frozen=True)
class LabelRun:
    """The labelled table with its column ``target``, one row of counts, and the first rows."""

    data: DataFrame
    summary: DataFrame
    preview: DataFrame
    text: str


def _finished(labelled: DataFrame, text: str, row_idx: str) -> LabelRun:
    data = checkpoint(labelled)  # counted, shown and kept: labelled once
    return LabelRun(data, label_summary(data), data.orderBy(row_idx).limit(PREVIEW_ROWS), text)


def label_with_keywords(
    df: DataFrame,
    keywords: Mapping[str, Sequence[str]] | None = None,
    lists: Mapping[str, DataFrame] | None = None,
    text: str | None = None,
    row_idx: str = "row_idx",
) -> LabelRun:
    """By the given keywords, else by the word tables of the labels; an error where there are none."""
    text = text or text_column(df, "longest", row_idx)
    given = {name: list(words) for name, words in (keywords or {}).items() if words}
    if given:
        return _finished(df.withColumn("target", label_by_keywords(F.col(text), given)), text, row_idx)
    held = {name: words for name, words in (lists or {}).items() if not words.isEmpty()}
    if not held:
        raise ValueError("no keywords given and none on file")
    return _finished(label_by_keyword_tables(df, text, held, row_idx), text, row_idx)


def label_with_clusters(df: DataFrame, method: str = "kmeans", text: str | None = None, row_idx: str = "row_idx", **options) -> LabelRun:
    """Cluster the texts; the three smallest cluster ids become the labels."""
    if method not in CLUSTERINGS:
        raise ValueError(f"unknown clustering {method!r}")
    text = text or text_column(df, "longest", row_idx)
    clusters = CLUSTERINGS[method](df.select(row_idx, text), text, **options).select(row_idx, "cluster")
    labelled = label_clusters(checkpoint(clusters)).select(row_idx, "cluster", "target")
    rest = df.drop("cluster", "target")
    return _finished(rest.join(labelled, row_idx), text, row_idx)


def label_with_annotations(df: DataFrame, annotations: DataFrame, stop_early: bool = False, text: str | None = None, row_idx: str = "row_idx") -> LabelRun:
    """The last annotation of each row; with ``stop_early`` only the annotated rows stay."""
    text = text or text_column(df, "sample", row_idx)
    return _finished(label_manual(df, annotations, row_idx, stop_early=stop_early), text, row_idx)
