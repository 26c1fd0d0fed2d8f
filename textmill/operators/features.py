"""Term counts, vocabulary and TF-IDF weights as long tables, plus the MLlib vector form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    IDF,
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    RegexTokenizer,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.stopwords import ENGLISH
from textmill.functions.tokens import TERM_PATTERN, ngrams, terms, token_counts, words

MAX_FEATURES = 5000
BROADCAST_TERMS = 100_000


def term_counts(
    df: DataFrame, text: str, ngram: str = "unigram", feature_rep: str = "count", row_idx: str = "row_idx"
) -> DataFrame:
    """(row_idx, token, n): n-gram counts per row, or 1 per distinct token when binary."""
    grams = ngrams(words(F.col(text)), ngram)
    if feature_rep == "binary":
        return df.select(row_idx, F.explode(F.array_distinct(grams)).alias("token"), F.lit(1).cast("bigint").alias("n"))
    # counted inside the row: neither texts nor tokens are shuffled
    return df.select(row_idx, F.inline(token_counts(grams)))


def document_terms(
    df: DataFrame, text: str, stop_words: Sequence[str] = ENGLISH, row_idx: str = "row_idx"
) -> DataFrame:
    """(row_idx, term, tf) without stop words, counted inside the row."""
    counted = df.select(row_idx, F.inline(token_counts(terms(F.col(text))))).toDF(row_idx, "term", "tf")
    return counted.filter(~F.col("term").isin(*stop_words)) if stop_words else counted


def vocabulary(counts: DataFrame, max_features: int | None = MAX_FEATURES) -> DataFrame:
    """(term, freq, df) of the most frequent terms; ties go to the smaller term."""
    terms_ = counts.groupBy("term").agg(F.sum("tf").alias("freq"), F.count("*").alias("df"))
    return terms_.orderBy(F.desc("freq"), "term").limit(max_features) if max_features else terms_


def tfidf(
    df: DataFrame,
    text: str,
    max_features: int = MAX_FEATURES,
    stop_words: Sequence[str] = ENGLISH,
    row_idx: str = "row_idx",
) -> DataFrame:
    """(row_idx, term, df, weight): smoothed idf, rows scaled to length one.

    The vocabulary has at most ``max_features`` rows, which bounds the broadcast (it is hinted up to
    BROADCAST_TERMS rows, a hint that changes no result). Terms are counted inside the row.
    """
    counts = document_terms(df, text, stop_words, row_idx)
    vocab = vocabulary(counts, max_features).select("term", "df")
    if max_features <= BROADCAST_TERMS:
        vocab = F.broadcast(vocab)
    n = df.agg(F.count("*")).scalar()
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1
    weighted = counts.join(vocab, "term").select(row_idx, "term", "df", (F.col("tf") * idf).alias("raw"))
    rows = weighted.groupBy(row_idx).agg(
        F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"),
        F.collect_list(F.struct("term", "df", "raw")).alias("terms"),
    )
    return rows.select(row_idx, "norm", F.inline("terms")).select(
        row_idx, "term", "df", (F.col("raw") / F.col("norm")).alias("weight")
    )


def fit_vectoriser(
    df: DataFrame, text: str, max_features: int = MAX_FEATURES, stop_words: Sequence[str] = ENGLISH
) -> PipelineModel:
    """The same weights as sparse MLlib vectors in the column ``features``, over the same vocabulary."""
    # frequencies alone need no counts by row
    found = df.select(F.explode(terms(F.col(text))).alias("term"), F.lit(1).cast("bigint").alias("tf"))
    counted = found.filter(~F.col("term").isin(*stop_words)) if stop_words else found
    # at most max_features terms, which the MLlib model holds anyway
    chosen = [r["term"] for r in vocabulary(counted, max_features).orderBy(F.desc("freq"), "term").collect()]
    counting = Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="__tokens", pattern=TERM_PATTERN, gaps=False, minTokenLength=2),
            CountVectorizerModel.from_vocabulary(chosen, inputCol="__tokens", outputCol="__counts"),
            IDF(inputCol="__counts", outputCol="__idf"),
        ]
    ).fit(df)
    *front, idf = counting.stages
    plus_one = Vectors.dense(idf.idf.toArray() + 1.0)
    return PipelineModel(
        [
            *front,
            ElementwiseProduct(scalingVec=plus_one, inputCol="__counts", outputCol="__weighted"),
            Normalizer(inputCol="__weighted", outputCol="features", p=2.0),
        ]
    )


def vectorise(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("__tokens", "__counts", "__weighted")
