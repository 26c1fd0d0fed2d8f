"""Training and prediction runs over the classifiers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.text import truncate
from textmill.operators.classify import (
    KeywordModel,
    NaiveBayesModel,
    NeighbourModel,
    TreeModel,
    check_split,
    fit_naive_bayes,
    fit_neighbours,
    fit_tree,
    load_model,
    predict_naive_bayes,
    predict_neighbours,
    predict_tree,
    save_model,
    stratified_split,
)
from textmill.operators.columns import detect_target_column, text_column
from textmill.operators.evaluate import metric_report, rand_index
from textmill.operators.labelling import classify_by_keywords, label_percentages, label_summary
from textmill.sources.runs import choose_artefact, latest_per_key
from textmill.sources.scratch import checkpoint


@dataclass(frozen=True)
class TrainedRun:
    model: object
    predictions: DataFrame
    metrics: DataFrame
    options: dict = field(default_factory=dict)


def fit(df: DataFrame, algorithm: str, text: str, target: str = "target", row_idx: str = "row_idx", **params):
    """Fit one of naive_bayes, knn, naive_automatic, decision_tree."""
    if algorithm == "naive_bayes":
        return fit_naive_bayes(df, text, target, params.get("ngram", "unigram"), params.get("feature_rep", "count"))
    if algorithm == "knn":
        return fit_neighbours(df, text, target, params.get("k", 5), row_idx)
    if algorithm == "naive_automatic":
        return KeywordModel(tuple(params["positives"]), tuple(params["negatives"]))
    if algorithm == "decision_tree":
        return fit_tree(df, text, target, params.get("max_depth"))
    raise ValueError(f"unknown algorithm {algorithm!r}")


def predict(model, df: DataFrame, text: str, row_idx: str = "row_idx") -> DataFrame:
    """(row_idx, predicted) for a table of texts."""
    if isinstance(model, KeywordModel):
        label = classify_by_keywords(F.col(text), model.positives, model.negatives)
        return df.select(row_idx, label.alias("predicted"))
    scorers = {
        NaiveBayesModel: predict_naive_bayes,
        NeighbourModel: predict_neighbours,
        TreeModel: predict_tree,
    }
    return scorers[type(model)](model, df, text, row_idx).select(row_idx, "predicted")


def train(
    df: DataFrame,
    algorithm: str,
    text: str | None = None,
    target: str = "target",
    test_size: float = 0.2,
    seed: int = 42,
    row_idx: str = "row_idx",
    strategy: str = "name",
    **params,
) -> TrainedRun:
    """Split, fit on the training part and judge on the validation part."""
    if target not in df.columns:
        raise ValueError(f"training needs the column {target!r}; label the table first")
    if text is None:
        # labelled data start with the label
        first = [row_idx, target, *(c for c in df.columns if c not in (row_idx, target))]
        text = text_column(df.select(*first) if strategy == "first" else df, strategy, row_idx)
    rows = df.select(row_idx, text, F.col(target).cast("int").alias("target")).filter(F.col("target").isNotNull())
    check_split(rows, "target", test_size)
    parts = stratified_split(rows, "target", test_size, seed, row_idx)
    training = parts.filter(~F.col("is_validation")).drop("is_validation")
    validation = parts.filter("is_validation").drop("is_validation")
    model = fit(training, algorithm, text, "target", row_idx, **params)
    judged = validation.select(row_idx, F.col("target").alias("actual")).join(
        predict(model, validation, text, row_idx), row_idx
    )
    judged = checkpoint(judged)  # scored once, whatever is made of it
    return TrainedRun(model, judged, metric_report(judged), {"algorithm": algorithm, **params})


@dataclass(frozen=True)
class PredictedDataset:
    """All predictions, the first 100 for display, label counts, and metrics when a usable target exists.

    ``error`` says why there are no metrics although a target column exists.
    """

    predictions: DataFrame
    preview: DataFrame
    distribution: DataFrame
    percentages: DataFrame
    metrics: DataFrame | None
    error: str | None = None


def predict_dataset(
    model, df: DataFrame, text: str | None = None, row_idx: str = "row_idx", preview_rows: int = 100
) -> PredictedDataset:
    """Score a table once; counts and metrics read the written predictions, the preview scores its own rows."""
    text = text or text_column(df, "name_long", row_idx)
    predicted = checkpoint(predict(model, df, text, row_idx))
    first = df.select(row_idx, text).orderBy(row_idx).limit(preview_rows)
    shown = first.join(predict(model, first, text, row_idx), row_idx).select(
        row_idx, truncate(F.col(text)).alias("tweet"), F.col("predicted").alias("predicted_label")
    )
    target = detect_target_column([c for c in df.columns if c not in (row_idx, text)])
    metrics, error = None, None
    if target:
        actual = df.select(row_idx, F.col(target).try_cast("int").alias("actual")).filter("actual IS NOT NULL")
        if actual.isEmpty():
            error = f"the column {target!r} holds no integer label"
        else:
            metrics = metric_report(actual.join(predicted, row_idx))
    distribution = label_summary(predicted, "predicted")
    return PredictedDataset(predicted, shown, distribution, label_percentages(predicted, "predicted"), metrics, error)


def predict_texts(model, texts: DataFrame, text: str = "text", row_idx: str = "row_idx") -> DataFrame:
    """(row_idx, text, predicted) for one or many texts given as a table."""
    return texts.select(row_idx, text).join(predict(model, texts, text, row_idx), row_idx)


# --- runs that are stored -----------------------------------------------------------------------


RUNS = "session_id string, model_id string, created_at timestamp, algorithm string, accuracy double, precision double, recall double, f1 double, error_rate double, rand_index double"  # noqa: E501
REPORTED = ("accuracy", "precision", "recall", "f1", "error_rate")


def read_runs(spark: SparkSession, store: str) -> DataFrame:
    """The run table of a store, empty before the first run."""
    try:
        return spark.read.schema(RUNS).parquet(f"{store}/runs")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUNS)


def train_and_store(artefacts: DataFrame, store: str, session_id: str, algorithm: str, created_at, **options) -> str:
    """Train on the most refined artefact of a session, store the model, add a run, return the model's id.

    ``artefacts`` holds one row with the paths of the stages (see ``choose_artefact``); the text column of
    labelled data is detected by the "first" strategy unless ``text`` names it.
    """
    spark = artefacts.sparkSession
    path = artefacts.select(choose_artefact("train").alias("path")).first()["path"]
    if not path:
        raise ValueError("nothing to train on")
    df = spark.read.parquet(path)
    run = train(df, algorithm, strategy="first", **options)
    model_id = uuid.uuid4().hex
    save_model(run.model, f"{store}/models/{model_id}")
    agreement = rand_index(run.predictions).select("rand_index").scalar()
    row = run.metrics.select(
        F.lit(session_id).alias("session_id"), F.lit(model_id).alias("model_id"), F.lit(created_at).cast("timestamp").alias("created_at"),
        F.lit(algorithm).alias("algorithm"), *REPORTED, agreement.alias("rand_index"),
    )
    row.write.mode("append").parquet(f"{store}/runs")
    return model_id


def _latest(runs: DataFrame) -> DataFrame:
    return latest_per_key(runs, ["session_id"], ["created_at", "model_id"])


def predict_latest(spark: SparkSession, store: str, session_id: str, df: DataFrame, **options) -> PredictedDataset:
    """Score a table with the model of the session's latest run."""
    last = _latest(read_runs(spark, store).filter(F.col("session_id") == session_id)).first()
    if last is None:
        raise ValueError(f"no trained model in session {session_id!r}")
    kind = "tree" if last["algorithm"] == "decision_tree" else "tables"
    return predict_dataset(load_model(spark, f"{store}/models/{last['model_id']}", kind), df, **options)


def evaluation_report(runs: DataFrame) -> DataFrame:
    """Metrics and rand index of the latest run of each session; an accuracy of 0 is a result like any other."""
    return _latest(runs).select("session_id", "model_id", "algorithm", *REPORTED, "rand_index")
