"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The tokenizer is built from a file of ranks. Each byte stands as one printable character in its
vocabulary; a token's merges are all the ways to put it together from two tokens of the file, in the
order of the ranks, which makes the library choose what a search for the lowest rank chooses.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.chunks import giving_back, pieces, worker_encoder
from textmill.llm.common import table
from textmill.llm.registry import query


TEXT_AT_A_TIME = 1 << 20  # bytes; a longer text is worked on by itself
KEPT_CHUNKS = 150_000  # encoded chunks that a worker keeps


def byte_characters() -> list[str]:
    """The character for each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in prints}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """The serialised tokenizer of a table of ranks; it travels to the workers with the job."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    characters = byte_characters()
    shown = {token: "".join(characters[b] for b in token) for token in ranks}
    merges = [
        (shown[token[:k]], shown[token[k:]])
        for token in sorted(ranks, key=ranks.get)
        for k in range(1, len(token))
        if token[:k] in ranks and token[k:] in ranks
    ]
    model = models.BPE({shown[t]: r for t, r in ranks.items()}, merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer.to_str()


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id; ids without a token have none."""
    found = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        found[rank] = token
    return found


def decode_text(parts: list[bytes], ids: list[int]) -> str:
    """The text of ids; characters that are cut off at either end become U+FFFD."""
    return b"".join(map(parts.__getitem__, ids)).decode("utf-8", errors="replace")


def character_offsets(parts: list[bytes], ids: list[int]) -> list[tuple[int, int]]:
    """(start, end) in characters of each id; a character split over ids belongs to each of them."""
    data = b"".join(map(parts.__getitem__, ids))
    begins = np.array([b & 0xC0 != 0x80 for b in data], np.int64)
    seen = np.concatenate([[0], np.cumsum(begins)])
    ends = np.cumsum([len(parts[i]) for i in ids], dtype=np.int64)
    starts = ends - [len(parts[i]) for i in ids]
    inside = lambda p: p < len(data) and not begins[p]
    return [(int(seen[s]) - bool(inside(s) and seen[s]), int(seen[e])) for s, e in zip(starts, ends, strict=True)]


def _load(text: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


def encode(documents: DataFrame, text: str, serialised: str, out: str = "ids") -> DataFrame:
    """``documents`` with a last column ``out`` (array<int>): the ids of each text.

    Null and empty texts get an empty array; repeated rows stay; an empty table gives an empty result.
    The other columns pass through whatever their names; a column ``out`` of the input is replaced.
    """
    key = hashlib.sha256(serialised.encode()).hexdigest()
    kept = [c for c in documents.columns if c != out]
    schema = documents.select(*[f"`{c}`" for c in kept], F.array().cast("array<int>").alias(out)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(key, lambda: _load(serialised))
        encoder.kept = KEPT_CHUNKS
        at = kept.index(text)
        for batch in _sliced(batches, at):
            ids, counts = encoder.texts(batch.column(at))
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*kept, out])

    return documents.select(*[f"`{c}`" for c in kept]).mapInArrow(work, schema)


def _sliced(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(iter([batch]), at, TEXT_AT_A_TIME):
            yield part


def decode(encoded: DataFrame, ids: str, parts: list[bytes], out: str = "decoded") -> DataFrame:
    """``encoded`` with a last column ``out`` (binary): the bytes of each list of ids, none for null."""
    kept = [c for c in encoded.columns if c != out]
    schema = encoded.select(*[f"`{c}`" for c in kept], F.lit(b"").alias(out)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.index(ids)
        for batch in batches:
            column = [b"".join(map(parts.__getitem__, x or ())) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column, pa.binary())], names=[*kept, out])

    return encoded.select(*[f"`{c}`" for c in kept]).mapInArrow(work, schema)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(documents: DataFrame, serialised: str, parts: list[bytes]) -> DataFrame:
    """Per row of ``documents(doc_id, text)`` the digests of its ids and of the bytes they decode to.

    Encoding, decoding and hashing run in one pass, so that neither ids nor bytes leave the worker.
    """
    key = hashlib.sha256(serialised.encode()).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(key, lambda: _load(serialised))
        encoder.kept = KEPT_CHUNKS
        numbers = [str(i) for i in range(len(parts))]
        for batch in _sliced(batches, 1):
            ids, counts = encoder.texts(batch.column(1))
            rows, at = [], 0
            for n in counts.tolist():
                own = ids[at : at + n].tolist()
                at += n
                shown = " ".join(map(numbers.__getitem__, own)).encode()
                data = b"".join(map(parts.__getitem__, own))
                rows.append((hashlib.sha256(shown).hexdigest(), hashlib.sha256(data).hexdigest()))
            shas = [pa.array(x, pa.string()) for x in (zip(*rows, strict=True) if rows else ((), ()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), *shas], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(giving_back(work), DIGEST)


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    serialised = tokenizer_json(ranks, public_tokenizers.PATTERN)
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), serialised, token_bytes(ranks))
