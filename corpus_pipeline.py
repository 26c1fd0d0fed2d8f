"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

In every stage null and empty texts are texts without words: they are not toxic, no copies, hold no secrets, and the mix
takes none of their words. Rows that repeat stay together up to the mix, but for rows of the same id and class that
``near_duplicates`` keeps both of. A null doc_id is neither a copy nor labelled. Very long texts are worked on whole.
Columns beside those of documents pass through, whatever their names, up to the last stage. Empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textmill.llm.bpe import digests, read_ranks, token_bytes, tokenizer_json
from textmill.llm.common import table
from textmill.llm.minhash import one_of_each
from textmill.llm.mixing import mix
from textmill.llm.secrets import redact, scan
from textmill.llm.toxicity import THRESHOLD, fit, score
from textmill.sources.scratch import checkpoint, discard, new_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that the toxicity model scores at its threshold or above."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, out="toxicity_score")
    return scored.filter(scored["toxicity_score"] < THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of the smallest id."""
    return one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask what the secret scan finds; all documents stay."""
    return redact(scan(docs, "text", new_path(spark, "ledger")), "text")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix by source asks for."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's ids and of the bytes that they decode to."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return digests(docs.select("doc_id", "text"), tokenizer_json(ranks, public_tokenizers.PATTERN), token_bytes(ranks))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixing", mixing),
    ("encoding", encoding),
]
#: None: a trained network and sampled signatures have no SQL form; tests/llm tests the stages' operators by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        read, docs = docs, checkpoint(stage(spark, docs, sf_dir))
        discard(read)  # only stages' own tables are deleted
    return STAGES[-1][1](spark, docs, sf_dir)
