"""Cross-tokenizer alignment: groups of tokens that cover the same bytes, and counts of the id pairs they link.

Two tokenizers, A (byte-level BPE) and B (pieces with byte fallback), encode a space and the text. Where tokens of
both end at the same byte, a group ends, and the two tokens that end there are linked. Counting the links of
the whole corpus takes two passes. The first one aligns the documents and gathers in each task the pairs it
met, with their numbers. The distinct pairs are given numbers by a minimal perfect hash; each task's counts
become a dense vector in that order, and the vectors are summed as a tree. The second pass aligns the
documents again and looks the counts up; the hash holds its keys, so no pair takes another one's count.

Linked tokens end together, so one of them is a suffix of the other. There are no more such pairs than bytes in
both vocabularies (about half a million for the given ones), times two where a piece stands for a byte
that has a piece of its own. So the tables of pairs that reach the driver and all tasks are bounded by the
vocabularies, whatever the corpus.

Texts are encoded once: the first pass writes the ids to the shared folder, the second one reads them.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.bpe import byte_characters
from textmill.llm.chunks import ChunkEncoder, pieces, ragged, text_bytes
from textmill.llm.common import partitions, table
from textmill.llm.perfect_hash import PerfectHash
from textmill.llm.registry import query
from textmill.sources.scratch import checkpoint, discard

TEXT_AT_A_TIME = 2 << 20  # bytes; a longer text is worked on by itself
TOKENS_AT_A_TIME = 1 << 18  # whose numbers are written together
KEPT_CHUNKS = 150_000  # of each tokenizer; an executor's workers hold both tables
PAIRS_KEPT = 1 << 21  # counted pairs of a task that wait to be added up
COUNT_CHUNKS = 16  # rows in which a vector of counts travels
SPACE = "▁"  # fixed value: how a piece writes a space


def vocabulary_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer, its written characters mapped back to bytes."""
    of = {c: b for b, c in enumerate(byte_characters())}
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    found = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        found[i] = bytes(of[c] for c in token)
    return found


def piece_bytes(model) -> list[bytes]:
    """The bytes of each piece: a byte piece is its byte, any other one is its text with spaces for SPACE."""
    written = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(written)]


class PieceEncoder(ChunkEncoder):
    """Encodes texts that start with a space by a piece model that adds it, distinct chunks once.

    The model does not merge over the border from a character to the space after it unless it has a piece with
    such a border; with such a model texts are not cut.
    """

    def __init__(self, model):
        self.model, self.added = model, []
        self.may_cut = not any(SPACE in model.id_to_piece(i).lstrip(SPACE) for i in range(model.get_piece_size()))
        self.lone_space = model.piece_to_id(SPACE)
        self._clear()

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # the model adds the space that each chunk starts with, but not to nothing
        found = [ids or [self.lone_space] for ids in self.model.encode([c[1:] for c in chunks], num_threads=1)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.may_cut:
            return super().texts(column)
        some = pc.fill_null(pc.not_equal(column, ""), False)
        counts = np.zeros(len(column), np.int64)
        ids, counts[some.to_numpy(zero_copy_only=False)] = self.encode(column.filter(some).to_pylist())
        return ids, counts


class Ragged:
    """Byte strings laid end to end, looked up by number."""

    def __init__(self, parts: list[bytes]):
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __getitem__(self, numbers: np.ndarray) -> np.ndarray:
        return ragged(self.data, self.starts[numbers], self.sizes[numbers])


class Aligner:
    """Encodes texts with both tokenizers and aligns the ids."""

    def __init__(self, serialised_a: str, model_b: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        tokenizer, model = Tokenizer.from_str(serialised_a), SentencePieceProcessor(model_proto=model_b)
        self.a, self.b = ChunkEncoder(tokenizer), PieceEncoder(model)  # special tokens are plain text
        self.a.kept = self.b.kept = KEPT_CHUNKS
        self.a_bytes, self.b_bytes = Ragged(vocabulary_bytes(tokenizer)), Ragged(piece_bytes(model))
        most = max(len(self.a_bytes.sizes), len(self.b_bytes.sizes))
        self.width = np.dtype("<u2" if most <= 1 << 16 else "<u4")  # in which ids are stored
        self.numbers = Ragged([b"%d," % i for i in range(most)])

    def encode(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts in a row, number of ids of each) of A and of B.

        Null and empty texts have no ids, and neither have those whose bytes the ids do not give back.
        """
        column = pc.fill_null(column.cast(pa.string()), "")
        spaced = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise("", column, " "))
        offsets, data = text_bytes(spaced)
        found, same = [], np.ones(len(column), bool)
        for encoder, known in ((self.a, self.a_bytes), (self.b, self.b_bytes)):
            ids, counts = encoder.texts(spaced)
            ids = ids.astype(np.int64)
            found.append((ids, counts))
            same &= _sums(known.sizes[ids], counts) == np.diff(offsets)
            if same.all() and (known[ids] == data).all():
                continue
            at = np.concatenate([[0], np.cumsum(counts)])
            for i in np.flatnonzero(same).tolist():  # some text of this batch is not given back
                same[i] = (known[ids[at[i] : at[i + 1]]] == data[offsets[i] : offsets[i + 1]]).all()
        return [(ids[np.repeat(same, counts)], np.where(same, counts, 0)) for ids, counts in found]

    def common_ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of A's and of B's tokens that end where one of the other ends; ids over the same bytes."""
        ends = [np.cumsum(known.sizes[ids]) for known, ids in ((self.a_bytes, a), (self.b_bytes, b))]
        marks = np.zeros((2, int(ends[0][-1]) + 1 if len(a) else 1), bool)
        marks[0, ends[0]] = marks[1, ends[1]] = True
        return np.flatnonzero(marks[1, ends[0]]), np.flatnonzero(marks[0, ends[1]])

    def shown(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> pa.Array:
        """The groups of each text as text, for tokens of all texts in a row."""
        # a token stands behind all tokens of its own kind before it, and those of the other kind in groups before
        # its own; B's also behind A's of its own group
        ids, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        group_a, group_b = (np.cumsum(_flags(at, n)) - _flags(at, n) for at, n in ((at_a, len(a)), (at_b, len(b))))
        places = np.arange(len(a)) + np.concatenate([[0], at_b + 1])[group_a], np.arange(len(b)) + (at_a + 1)[group_b]
        for place, own, at, last in ((places[0], a, at_a, b"|"), (places[1], b, at_b, b";")):
            ids[place] = own
            marks[place] = ord(",")
            marks[place[at]] = ord(last)
        text_ends = np.cumsum(n_a + n_b)
        marks[text_ends[n_a > 0] - 1] = 0  # the last group of a text has no mark
        sizes = self.numbers.sizes[ids] - (marks == 0)
        parts = []
        for i in range(0, len(ids), TOKENS_AT_A_TIME):
            own = slice(i, i + TOKENS_AT_A_TIME)
            part = self.numbers[ids[own]]
            part[np.cumsum(self.numbers.sizes[ids[own]]) - 1] = marks[own]
            parts.append(part[part != 0])
        offsets = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], text_ends])]
        data = np.concatenate(parts) if parts else np.empty(0, np.uint8)
        return pa.LargeStringArray.from_buffers(len(n_a), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _flags(at: np.ndarray, n: int) -> np.ndarray:
    flags = np.zeros(n, np.int64)
    flags[at] = 1
    return flags


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of ``counts`` values."""
    sums = np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])]
    return np.diff(sums)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << 32 | b


_aligners: dict[str, Aligner] = {}


def _aligner(tokenizers) -> Aligner:
    """The aligner of this Python worker, loaded once."""
    key, serialised_a, model_b = tokenizers.value
    if key not in _aligners:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel units
        _aligners[key] = Aligner(serialised_a, model_b)
    return _aligners[key]


def _send(spark: SparkSession, serialised_a: str, model_b: bytes):
    key = hashlib.sha256(serialised_a.encode() + model_b).hexdigest()
    return spark.sparkContext.broadcast((key, serialised_a, model_b))  # two files of fixed size


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, counts)
    return own, total


def encoded(documents: DataFrame, text: str, keep: list[str], tokenizers) -> DataFrame:
    """The columns ``keep`` of ``documents`` as a struct and, as bytes, the ids of A and of B."""
    rows = documents.select(F.struct(*[f"`{c}`" for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = rows.select("row", F.lit(b"").alias("a"), F.lit(b"").alias("b")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(tokenizers)
        for batch in pieces(batches, "text", TEXT_AT_A_TIME):
            columns = [batch.column("row")]
            for ids, counts in aligner.encode(batch.column("text")):
                offsets = (aligner.width.itemsize * np.concatenate([[0], np.cumsum(counts)])).astype(np.int32)
                columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(aligner.width))]))
            yield pa.RecordBatch.from_arrays(columns, names=["row", "a", "b"])

    return rows.mapInArrow(work, schema)


def _stored(batch: pa.RecordBatch, aligner: Aligner) -> list[np.ndarray]:
    """[ids of A, number of them by text, ids of B, number of them by text]."""
    out = []
    for name in ("a", "b"):
        column = batch.column(name)
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
        held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        out += [held.view(aligner.width).astype(np.int64), np.diff(offsets).astype(np.int64) // aligner.width.itemsize]
    return out


def task_pairs(ids: DataFrame, tokenizers) -> DataFrame:
    """(pair, n) of ``ids(a, b)``: how often each task saw a pair of ids linked, A's id in the upper half."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(tokenizers)
        waiting = [np.empty((0, 2), np.int64)]
        for batch in pieces(batches, "a", TEXT_AT_A_TIME):
            a, _, b, _ = _stored(batch, aligner)
            at_a, at_b = aligner.common_ends(a, b)
            waiting.append(np.stack(np.unique(_pair(a[at_a], b[at_b]), return_counts=True), axis=1))
            if sum(map(len, waiting)) > PAIRS_KEPT:
                waiting = [_summed(np.concatenate(waiting))]
        pairs = _summed(np.concatenate(waiting))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["pair", "n"])

    return ids.select("a", "b").mapInArrow(work, "pair long, n long")


def _summed(pairs: np.ndarray) -> np.ndarray:
    own, at = np.unique(pairs[:, 0], return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, pairs[:, 1])
    return np.stack([own, total], axis=1)


def _tree_sum(counted: DataFrame, hashed, n: int) -> np.ndarray:
    """The counts of all pairs as one vector in the order of the hash.

    A task turns the counts it reads into a vector; some tasks add the vectors of all others up, and one task
    for each part of the vector finishes it. Only the finished parts reach the driver.
    """
    size = -(-n // COUNT_CHUNKS)

    def rows_of(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        parts = [x.tobytes() for x in total.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "part"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, own = np.zeros(size * COUNT_CHUNKS, np.int64), hashed.value
        for batch in batches:
            np.add.at(seen, own.index(batch.column(0).to_numpy()), batch.column(1).to_numpy())
        yield rows_of(dict(enumerate(seen.reshape(COUNT_CHUNKS, size))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(part, np.int64)
                total[k] = total[k] + part if k in total else part
        yield rows_of(total)

    schema = "chunk int, part binary"
    some = max(1, partitions(counted.sparkSession) // 8)
    summed = counted.mapInArrow(count, schema).repartition(some).mapInArrow(add, schema)
    rows = summed.repartition(COUNT_CHUNKS, "chunk").mapInArrow(add, schema).collect()
    found = {r["chunk"]: np.frombuffer(r["part"], np.int64) for r in rows}
    return np.concatenate([found[k] for k in range(COUNT_CHUNKS)])[:n]


class PairCounts:
    """The corpus-wide counts of all linked pairs, by perfect hash, and the highest count of each id of B."""

    def __init__(self, hashed: PerfectHash, counts: np.ndarray):
        self.hashed, self.counts = hashed, counts
        self.b_ids = (hashed.keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.highest = np.zeros(int(self.b_ids.max(initial=-1)) + 1, np.int64)
        np.maximum.at(self.highest, self.b_ids, counts)

    def of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is its B id's highest) of each pair; 0 and False for pairs that were never met."""
        at = self.hashed.index(pairs)
        if not len(self.counts):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        counts = np.where(at >= 0, self.counts[at], 0)
        return counts, (at >= 0) & (counts == self.highest[self.b_ids[at]])


def count_pairs(ids: DataFrame, tokenizers) -> PairCounts:
    """The counts of all linked pairs of ``ids(a, b)``."""
    counted = checkpoint(task_pairs(ids, tokenizers))
    # at most as many as the vocabularies have bytes, see above
    keys = counted.select("pair").distinct().toArrow()["pair"].to_numpy()
    hashed = PerfectHash(keys.astype(np.uint64))
    counts = np.zeros(0, np.int64)
    if len(keys):
        counts = _tree_sum(counted, ids.sparkSession.sparkContext.broadcast(hashed), len(keys))
    discard(counted)
    return PairCounts(hashed, counts)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(documents: DataFrame, serialised_a: str, model_b: bytes, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``documents`` with n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups (string) as last columns.

    ``groups`` is `a1,a2|b1;a3|b2,b3`: the ids of A and B of each group. A link is best if no other id of A is
    linked to its id of B more often in all documents; ties are best too. Null and empty texts, and texts that the
    tokens do not give back byte by byte, have no tokens: zeros and an empty string. Repeated rows count as
    often as they stand. The columns ``keep`` (all, unless given) pass through whatever their names; columns
    of the input named as a new one are replaced. Very long texts are aligned whole. An empty table gives an empty
    result.
    """
    spark = documents.sparkSession
    tokenizers = _send(spark, serialised_a, model_b)
    kept = [c for c in (documents.columns if keep is None else keep) if c not in (*NUMBERS, "groups")]
    ids = checkpoint(encoded(documents, text, kept, tokenizers))
    known = spark.sparkContext.broadcast(count_pairs(ids, tokenizers))
    schema = ids.select("row", *[F.lit(0).cast("long").alias(c) for c in NUMBERS], F.lit("").alias("groups")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, counts = _aligner(tokenizers), known.value
        for batch in pieces(batches, "a", TEXT_AT_A_TIME):
            a, n_a, b, n_b = _stored(batch, aligner)
            at_a, at_b = aligner.common_ends(a, b)
            count, best = counts.of(_pair(a[at_a], b[at_b]))
            # no token is without bytes, so one link ends each group
            links = np.diff(np.searchsorted(at_a, np.concatenate([[0], np.cumsum(n_a)])))
            numbers = [n_a, n_b, links, links, _sums(best.astype(np.int64), links), _sums(count, links)]
            columns = [batch.column("row"), *[pa.array(x) for x in numbers], aligner.shown(a, n_a, b, n_b, at_a, at_b)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ids.mapInArrow(work, schema).select("row.*", *NUMBERS, "groups")


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        serialised = f.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    aligned = align(table(spark, sf_dir, "documents"), serialised, model, keep=["doc_id"])
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return aligned.select(
        F.col("doc_id").cast("long"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256")
    )
