"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and characters.

A word's input is made of its own hash and of the hashes of its stretches of characters: learned vectors
for both, and how much more often toxic training texts hold them than others. The network reads windows
of words; all overlapping windows of a text are scored, and the text takes the highest score. Training
knows only the label of the whole text: each step goes by the window that now scores highest.
"""

from __future__ import annotations

import gc
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import gru
from textmill.llm.chunks import give_back, giving_back, pieces, ragged
from textmill.llm.common import table
from textmill.llm.registry import query
from textmill.llm.words import gram_hashes, text_words
from textmill.sources.scratch import checkpoint, discard

WINDOW, STRIDE = 32, 16  # words
TRAIN_TOXIC, TRAIN_CLEAN = 1200, 2400  # labelled texts of each class that are taken, least hashes first
TRAIN_CHARACTERS, TRAIN_STRETCHES = 2000, 4  # of a labelled text that is trained on; all texts are scored whole
THRESHOLD = 0.3
GRAMS = (3, 4, 5)  # characters
ODDS_BITS, VECTOR_BITS = 20, 14  # sizes of the hashed tables
VECTOR, HIDDEN = 4, 8
STEPS, STEP_TOXIC, STEP_CLEAN = 360, 16, 32
SEED = 7
WINDOWS_AT_A_TIME, WORDS_AT_A_TIME = 8192, 8192
SCORED_BYTES = 4 << 20  # text that a worker scores at a time


@dataclass
class Features:
    """The distinct words of some texts: hashes of words and stretches, and the words at each place."""

    whole: np.ndarray
    grams: np.ndarray
    counts: np.ndarray
    places: np.ndarray
    edges: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Features:
        words, places, edges = text_words(column)
        # punctuation around and inside a word does not make it another one
        bare = pc.replace_substring_regex(words, r"[^\pL\pN]+", "")
        return cls(*gram_hashes(bare, GRAMS), places, edges)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts


def _slot(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def log_odds(slots: list[np.ndarray], labels: np.ndarray, bits: int = ODDS_BITS) -> np.ndarray:
    """For each slot the log of how much likelier a toxic text holds it, drawn to 0 where little is known."""
    seen = np.zeros((2, 1 << bits), np.float32)
    for own, label in zip(slots, labels, strict=True):
        seen[int(label), own] += 1
    n = np.bincount(labels.astype(int), minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    total = seen.sum(axis=0)
    return (odds * total / (total + 4)).astype(np.float32)


@dataclass
class Model:
    net: dict
    word_odds: np.ndarray
    gram_odds: np.ndarray
    word_vectors: np.ndarray
    gram_vectors: np.ndarray

    def inputs(self, f: Features, word_odds=None, gram_odds=None) -> np.ndarray:
        """A row for each distinct word and one of zeros for padding."""
        word_odds = self.word_odds if word_odds is None else word_odds
        gram_odds = self.gram_odds if gram_odds is None else gram_odds
        n = len(f.whole)
        rows = np.zeros((n + 1, 4 + 2 * VECTOR), np.float32)
        if not n:
            return rows
        rows[:n, 0] = word_odds[_slot(f.whole, ODDS_BITS)]
        rows[:n, 3] = 1
        rows[:n, 4 : 4 + VECTOR] = self.word_vectors[_slot(f.whole, VECTOR_BITS)]
        with_grams, first = np.flatnonzero(f.counts), f.starts
        for i in range(0, len(with_grams), WORDS_AT_A_TIME):
            some = with_grams[i : i + WORDS_AT_A_TIME]
            own = slice(first[some[0]], first[some[-1]] + f.counts[some[-1]])
            grams, starts = f.grams[own], first[some] - first[some[0]]
            odds = gram_odds[_slot(grams, ODDS_BITS)]
            rows[some, 1] = np.maximum.reduceat(odds, starts)
            rows[some, 2] = np.add.reduceat(odds, starts) / f.counts[some]
            vectors = self.gram_vectors[_slot(grams, VECTOR_BITS)]
            rows[some, 4 + VECTOR :] = np.add.reduceat(vectors, starts, axis=0) / f.counts[some, None]
        return rows

    def scores(self, column: pa.Array) -> np.ndarray:
        """The score of each text, 0 for one without words."""
        f = Features.of(column)
        out = np.zeros(len(column))
        windows, owners = text_windows(f.places, f.edges, len(f.whole))
        if len(windows):
            logit = self.window_logits(self.inputs(f), windows)
            first = np.flatnonzero(np.diff(owners, prepend=-1))
            # rounded, as sums depend in their last digits on what a text is scored beside
            best = np.maximum.reduceat(logit, first).astype(np.float64).round(4)
            out[owners[first]] = 1 / (1 + np.exp(-best))
        return out

    def window_logits(self, inputs: np.ndarray, windows: np.ndarray) -> np.ndarray:
        gates = {s: gru.projected(self.net, inputs, s) for s in ("f", "b")}
        some = [gru.logits(self.net, gates, windows[i : i + WINDOWS_AT_A_TIME]) for i in range(0, len(windows), WINDOWS_AT_A_TIME)]
        return np.concatenate(some) if some else np.empty(0, np.float32)


def text_windows(places: np.ndarray, edges: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, filled with ``pad``, and the text of each; the last window of a text ends it."""
    sizes = np.diff(edges)
    counts = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
    owners = np.repeat(np.arange(len(sizes)), counts)
    start = edges[owners] + STRIDE * ragged(np.arange(max(counts.max(initial=0), 1)), np.zeros(len(counts), np.int64), counts)
    padded = np.append(places, pad).astype(np.int32)
    windows = np.empty((len(owners), WINDOW), np.int32)
    for i in range(0, len(owners), WINDOWS_AT_A_TIME):
        part = slice(i, i + WINDOWS_AT_A_TIME)
        at = start[part, None] + np.arange(WINDOW)
        inside = at < edges[owners[part] + 1][:, None]
        windows[part] = padded[np.where(inside, at, len(places))]
    return windows, owners


def train(texts: list[str] | pa.Array, labels: np.ndarray) -> Model:
    """Fit a model to whole texts; both classes have to occur, else every score is 0."""
    rng = np.random.default_rng(SEED)
    small = lambda: (0.1 * rng.standard_normal((1 << VECTOR_BITS, VECTOR))).astype(np.float32)
    none = np.zeros(1 << ODDS_BITS, np.float32)
    model = Model(gru.new_network(4 + 2 * VECTOR, HIDDEN, rng), none, none, small(), small())
    if not (labels > 0).any() or not (labels == 0).any():
        model.net["b"][:] = -1e9
        return model
    f = Features.of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    own_words = [np.unique(f.places[a:b]) for a, b in zip(f.edges[:-1], f.edges[1:], strict=True)]
    word_slots = [np.unique(_slot(f.whole[w], ODDS_BITS)) for w in own_words]
    gram_slots = [np.unique(_slot(ragged(f.grams, f.starts[w], f.counts[w]), ODDS_BITS)) for w in own_words]
    # each half is trained with odds counted in the other half, as new texts will be
    half = rng.permutation(len(texts)) % 2
    inputs = []
    for side in (0, 1):
        other = np.flatnonzero(half != side)
        pick = lambda slots: log_odds([slots[i] for i in other], labels[other])
        inputs.append(model.inputs(f, pick(word_slots), pick(gram_slots)))
    model.word_odds, model.gram_odds = log_odds(word_slots, labels), log_odds(gram_slots, labels)

    pad = len(f.whole)
    windows, owners = text_windows(f.places, f.edges, pad)
    first = np.searchsorted(owners, np.arange(len(texts) + 1))
    usable = np.flatnonzero(np.diff(first))
    toxic, clean = usable[labels[usable] > 0], usable[labels[usable] == 0]
    adam = gru.Adam(model.net, 0.02)
    squares = [np.full_like(model.word_vectors, 1e-3), np.full_like(model.gram_vectors, 1e-3)]
    for step in range(STEPS if len(toxic) and len(clean) else 0):
        adam.rate = 0.02 * (1 - step / STEPS) + 0.001
        docs = np.concatenate([rng.choice(toxic, STEP_TOXIC), rng.choice(clean, STEP_CLEAN)])
        for side in (0, 1):
            own = docs[half[docs] == side]
            if not len(own):
                continue
            table = inputs[side]
            counts = first[own + 1] - first[own]
            rows = ragged(np.arange(len(windows)), first[own], counts)
            words, local = np.unique(windows[rows], return_inverse=True)
            local = local.reshape(len(rows), WINDOW)
            if words[-1] != pad:
                words = np.append(words, pad)
            words_in = table[words]
            words_in[:-1, 4:] = _vectors(model, f, words[:-1])
            # early on, the window with the most telling word; later the one that scores highest
            if step < STEPS // 4:
                worth = np.maximum(words_in[:, 0], words_in[:, 1])[local].max(axis=1)
            else:
                worth = model.window_logits(words_in, local)
            starts = np.cumsum(counts) - counts
            best = np.array([s + int(worth[s : s + c].argmax()) for s, c in zip(starts, counts, strict=True)])
            loss, grads, d_in = gru.gradients(model.net, words_in, local[best], labels[own].astype(np.float32))
            adam.update(grads)
            _move_vectors(model, f, words[:-1], d_in[:-1, 4:], squares)
    return model


def _vectors(model: Model, f: Features, words: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), 2 * VECTOR), np.float32)
    out[:, :VECTOR] = model.word_vectors[_slot(f.whole[words], VECTOR_BITS)]
    counts = f.counts[words]
    some = np.flatnonzero(counts)
    if len(some):
        slots = _slot(ragged(f.grams, f.starts[words[some]], counts[some]), VECTOR_BITS)
        sums = np.add.reduceat(model.gram_vectors[slots], np.cumsum(counts[some]) - counts[some], axis=0)
        out[some, VECTOR:] = sums / counts[some, None]
    return out


def _move_vectors(model: Model, f: Features, words: np.ndarray, d: np.ndarray, squares: list[np.ndarray]) -> None:
    used = np.flatnonzero(np.abs(d).max(axis=1) > 0)
    words, d = words[used], d[used]
    counts = f.counts[words]
    grams = ragged(f.grams, f.starts[words], counts)
    parts = (
        (model.word_vectors, _slot(f.whole[words], VECTOR_BITS), d[:, :VECTOR], squares[0]),
        (model.gram_vectors, _slot(grams, VECTOR_BITS), np.repeat(d[:, VECTOR:] / np.maximum(counts, 1)[:, None], counts, axis=0), squares[1]),
    )
    for vectors, slots, change, square in parts:
        own, at = np.unique(slots, return_inverse=True)
        total = np.zeros((len(own), VECTOR), np.float32)
        np.add.at(total, at, change)
        square[own] += total**2
        vectors[own] -= 0.02 * total / np.sqrt(square[own])


def is_held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """A model from a bounded sample of the labelled documents that are not held out.

    Labels that are null do not count; of repeated labels the highest does. Only labels whose document has words
    are drawn from, least hashes first: at most TRAIN_TOXIC and TRAIN_CLEAN. Of documents with the same id one
    text is taken. A text longer than TRAIN_CHARACTERS is trained on as stretches of it that cover it whole, as
    long as no more than TRAIN_STRETCHES are needed, else as so many evenly spaced ones; the label is known for the
    whole text only, and each step goes by its highest window. The sample is trained on in one task of its own, whose
    result, tables of fixed sizes, is all that reaches the driver.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter(
        "toxic IS NOT NULL AND id IS NOT NULL AND " "crc32(cast(id AS string)) % 4 <> 2"
    )
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = documents.select(F.col("doc_id").alias("id"), F.col("text")).filter(F.col("text").rlike(r"[^\s\x0B\x1C-\x1F\x{85}\x{A0}\p{Z}]"))
    usable = known.join(texts.select("id").distinct(), "id", "left_semi")
    take = lambda rows, n: rows.orderBy(F.xxhash64("id"), "id").limit(n)
    sample = checkpoint(take(usable.filter("toxic > 0"), TRAIN_TOXIC).unionByName(take(usable.filter("toxic <= 0"), TRAIN_CLEAN)))
    # at most TRAIN_TOXIC + TRAIN_CLEAN pairs of numbers are broadcast; repeated documents train once
    cut = F.transform(_stretches(F.length("text")), lambda at: F.substring(F.col("text"), at + 1, F.lit(TRAIN_CHARACTERS)))
    found = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    found = found.select("id", "toxic", F.array_join(cut, " ").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        model = train([], np.empty(0, np.int64))
        if held:
            rows = pa.Table.from_batches(held).sort_by("id")
            held.clear()
            model = train(rows["text"].combine_chunks(), (rows["toxic"].to_numpy() > 0).astype(np.int64))
        sent = pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        del held, model
        rows = None
        # the worker goes on to other tasks
        gc.collect()
        give_back()
        yield sent

    # one task for a bounded sample
    trained = found.repartition(1).mapInArrow(work, "model binary").first()
    discard(sample)
    return pickle.loads(trained["model"]) if trained else train([], np.empty(0, np.int64))


def _stretches(length: Column) -> Column:
    """Where the stretches of TRAIN_CHARACTERS characters of a text of this length start."""
    n = F.least(F.ceil(length / TRAIN_CHARACTERS), F.lit(TRAIN_STRETCHES)).cast("int")
    last = length - F.least(length, F.lit(TRAIN_CHARACTERS))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * last / F.greatest(n - 1, F.lit(1))).cast("int"))


def score(documents: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``documents`` with a last column ``out`` (double, 0 to 1), from the text alone.

    Null, empty and blank texts score 0; repeated rows score alike; very long texts are scored in all
    their windows. Other columns pass through whatever their names; a column ``out`` of the input is
    replaced. An empty table gives an empty result.
    """
    kept = [c for c in documents.columns if c != out]
    schema = documents.select(*[f"`{c}`" for c in kept], F.lit(0.0).alias(out)).schema
    sent = documents.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # tables of fixed sizes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = pickle.loads(sent.value), kept.index(text)
        for batch in batches:
            for part in pieces(iter([batch]), at, SCORED_BYTES):
                scores = pa.array(own.scores(part.column(at)), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*kept, out])

    return documents.select(*[f"`{c}`" for c in kept]).mapInArrow(giving_back(work), schema)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    # the texts stay in the scan's order and go no further than the worker
    scored = score(docs, model).select("doc_id", "score")
    return scored.select(
        "doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
