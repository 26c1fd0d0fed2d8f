"""Languages from character triples: a model counted from labelled texts, scored inside the task.

A triple of characters, with spaces around words, falls into one of SLOTS slots by a sum over its code points. The
model holds for each slot and language the log of the slot's smoothed share; a text belongs to the language with the
highest sum over its triples. The model is one row, with SLOTS numbers for each language; no language is known beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import WORD

# Slots, and the factors of a triple's second and third code point.
SLOTS = 4093
FACTORS = (1, 61, 3721)
CHARACTERS = 2_000_000  # of texts that are taken at a time
HELD_OUT = 5  # one of so many parts of the labelled rows is left out of the counts


def fold(row_idx: str, seed: int = 42) -> Column:
    """The part of a row, 0 to HELD_OUT - 1, by a digest of its number; part 0 is held out."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_idx).cast("string"))), 1, 6), 16, 10).cast("int") % HELD_OUT


def spaced(text: Column) -> Column:
    """The text's letters and digits, in lower case, runs of anything else as one space, with spaces around it."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{WORD}]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _portions(texts: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of ``spaced`` texts: which ones, the slots of all their triples and how many of these each text has."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + CHARACTERS, "right")))
        points = np.frombuffer("".join(texts[at:to].to_pylist()).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        found = sum(f * points[n : len(points) - 2 + n] for n, f in enumerate(FACTORS)) % SLOTS
        # triples across the end of a text do not count
        inside = np.ones(len(points), bool)
        last = ends[at:to] - done
        inside[last - 1] = inside[last - 2] = False  # no text is shorter than its two spaces
        yield slice(at, to), found[inside[: len(found)]], lengths[at:to] - 2
        at = to


def fit_languages(df: DataFrame, text: str, lang: str) -> DataFrame:
    """One row: ``languages`` (sorted by name) and for each its ``weights`` by slot, counted over all rows with a language.

    Slots are counted in the task, so that only counts are shuffled.
    """
    rows = df.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), spaced(F.col(text)).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("lang").dictionary_encode()
            codes = np.asarray(own.indices).astype(np.int64)
            seen = np.zeros(len(own.dictionary) * SLOTS, np.int64)
            for which, found, counts in _portions(batch.column("text")):
                seen += np.bincount(np.repeat(codes[which], counts) * SLOTS + found, minlength=len(seen))
            held = np.flatnonzero(seen)
            langs = own.dictionary.take(pa.array(held // SLOTS))
            yield pa.RecordBatch.from_arrays([langs, pa.array(held % SLOTS, pa.int32()), pa.array(seen[held])], names=["lang", "slot", "n"])

    kind = rows.schema["lang"].dataType.simpleString()
    counts = rows.mapInArrow(work, f"lang {kind}, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    per_lang = counts.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("held"), F.sum("n").alias("total"))
    share = lambda i: F.ln((F.coalesce(F.try_element_at("held", i), F.lit(0)) + 1) / (F.col("total") + SLOTS))
    logs = per_lang.select("lang", F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), share).alias("logs"))
    # one row for each language
    all_ = logs.agg(F.array_sort(F.collect_list(F.struct("lang", "logs"))).alias("found"))
    return all_.select(
        F.transform("found", lambda x: x["lang"]).alias("languages"), F.transform("found", lambda x: x["logs"]).alias("weights")
    )


def with_language(df: DataFrame, text: str, out: str, model: DataFrame) -> DataFrame:
    """``df`` with ``out``: the language of the highest score, the first by name on a tie; null without letters or digits.

    The model's row, SLOTS numbers for each language, is broadcast.
    """
    row = model.first()
    sent = df.sparkSession.sparkContext.broadcast((list(row["languages"]), np.array(row["weights"], float).reshape(-1, SLOTS)))

    @F.arrow_udf(model.schema["languages"].dataType.elementType)
    def best(texts: pa.Array) -> pa.Array:
        languages, weights = sent.value
        chosen = np.full(len(texts), -1, np.int64)
        for which, found, counts in _portions(texts) if len(languages) else ():
            some = np.flatnonzero(counts)
            if len(some):
                starts = (np.cumsum(counts) - counts)[some]
                scores = np.array([np.add.reduceat(w[found], starts) for w in weights])
                chosen[which.start + some] = scores.round(6).argmax(axis=0)
        return pa.array(languages, texts.type if not languages else None).take(pa.array(chosen, mask=chosen < 0))

    return df.withColumn(out, best(spaced(F.col(text))))


def by_model(model: DataFrame):
    """The ``detect`` of the cleaning run that goes by ``model``."""
    return lambda df, text, out: with_language(df, text, out, model)
