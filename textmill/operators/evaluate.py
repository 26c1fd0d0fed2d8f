"""Confusion matrix and the metrics that follow from it.

Every metric is computed from the (actual, predicted, n) cells, which are counted inside each task
first; the data is read once and only labels x labels rows are left afterwards. Cells and their sums by label stay
tables, so that thousands of labels are no array; only the matrix of a report is one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.sources.scratch import checkpoint

# Names of the labels and the fields of the three reports.
LABEL_TITLES = {0: "Negative", 2: "Neutral", 4: "Positive"}
REPORTS = {
    "train": ("accuracy", "precision", "recall", "f1", "error_rate", "confusion_matrix"),
    "classification": ("accuracy", "error_rate", "precision", "confusion_matrix"),
    "predictions": ("accuracy", "precision"),
}


def count_cells(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Observed cells (actual, predicted, n); rows without a true label do not count."""
    judged = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return judged.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def per_label(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(label, support, hits, precision, recall, f1); a division by zero gives 0."""
    return _margins(count_cells(df, actual, predicted)).drop("chosen")


def _margins(cells: DataFrame) -> DataFrame:
    """(label, support, chosen, hits, precision, recall, f1): each cell counts for both of its labels."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0).cast("bigint"))
    none = F.lit(0).cast("bigint")
    row = lambda c, support, chosen, hits: F.struct(F.col(c).alias("label"), support.alias("support"), chosen.alias("chosen"), hits.alias("hits"))
    sides = F.array(row("actual", F.col("n"), none, hit), row("predicted", none, F.col("n"), none))
    summed = cells.select(F.inline(sides)).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("support", "chosen", "hits")))
    ratio = lambda x, y: F.when(y > 0, F.try_divide(x, y)).otherwise(0.0)
    support, chosen, hits = F.col("support"), F.col("chosen"), F.col("hits")
    return summed.select(
        "label", "support", "chosen", "hits", ratio(hits, chosen).alias("precision"), ratio(hits, support).alias("recall"),
        # the harmonic mean of both, written on the counts
        ratio(2 * hits, chosen + support).alias("f1"),
    )


def _summary(cells: DataFrame) -> DataFrame:
    """One row: accuracy (null without rows), error_rate and the weighted precision, recall and f1."""
    rows = F.sum("support").cast("double")
    weighted = [F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), rows), F.lit(0.0)).alias(m) for m in ("precision", "recall", "f1")]
    accuracy = F.try_divide(F.sum("hits").cast("double"), rows)
    return _margins(cells).agg(accuracy.alias("accuracy"), (1 - accuracy).alias("error_rate"), *weighted)


def confusion_matrix(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n) over the union of both label sets, empty cells included."""
    return _grid(checkpoint(count_cells(df, actual, predicted)))


def _grid(cells: DataFrame) -> DataFrame:
    """All cells of the labels of written cells; the labels are one row, spread by label before they are paired."""
    labels = cells.select(F.explode(F.array("actual", "predicted")).alias("label")).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    actual = labels.select(F.explode("labels").alias("actual"), "labels").repartition("actual")
    pairs = actual.select("actual", F.explode("labels").alias("predicted"))
    return pairs.join(cells, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def confusion_matrix_wide(
    df: DataFrame, labels: Sequence[int], actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """One row per true label, one column per predicted label."""
    cells = confusion_matrix(df, actual, predicted)
    return cells.groupBy("actual").agg(
        *(F.sum(F.when(F.col("predicted") == v, F.col("n")).otherwise(0)).alias(f"pred_{v}") for v in labels)
    )


def confusion_heat(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Cells as a share of the largest cell, with label names."""
    cells = checkpoint(count_cells(df, actual, predicted))
    names = F.create_map(*(F.lit(v) for pair in LABEL_TITLES.items() for v in pair))
    name = lambda c: F.coalesce(names[F.col(c).cast("int")], F.col(c).cast("string")).alias(f"{c}_name")
    return _grid(cells).select(name("actual"), name("predicted"), "n", (F.col("n") / cells.agg(F.max("n")).scalar()).alias("heat"))


def weighted_prf(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: precision, recall and F1, weighted by the number of true rows."""
    return _summary(count_cells(df, actual, predicted)).select("precision", "recall", "f1")


def accuracy_error(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy and error_rate; NULL without judged rows."""
    return _summary(count_cells(df, actual, predicted)).select("accuracy", "error_rate")


def metric_report(
    df: DataFrame, actual: str = "actual", predicted: str = "predicted", report: str = "train"
) -> DataFrame:
    """One row with the fields of a report; the matrix is an array of (actual, predicted, n)."""
    cells = checkpoint(count_cells(df, actual, predicted))
    one = _summary(cells)
    if "confusion_matrix" in REPORTS[report]:
        matrix = _grid(cells).agg(F.array_sort(F.collect_list(F.struct("actual", "predicted", "n")))).scalar()
        one = one.withColumn("confusion_matrix", matrix)
    return one.select(*REPORTS[report])


def rand_index(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Share of row pairs on which both partitions agree, from the contingency table.

    The pair counts come from squared cell and margin totals; no pair is ever formed.
    """
    cells = count_cells(df, actual, predicted)
    pairs = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    rows = cells.groupBy("actual").agg(F.sum("n").alias("n")).agg(pairs("n")).scalar()
    columns = cells.groupBy("predicted").agg(F.sum("n").alias("n")).agg(pairs("n")).scalar()
    total = F.sum("n").cast("double")
    one = cells.agg(pairs("n").alias("both"), (total * (total - 1) / 2).alias("all"))
    agreed = F.col("all") + 2 * F.col("both") - rows - columns
    return one.select(F.when(F.col("all") > 0, agreed / F.col("all")).otherwise(1.0).alias("rand_index"))
