import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textmill.llm import bpe, simple8b, tokenfiles
from textmill.sources.scratch import new_path

public = pytest.importorskip("public_tokenizers")
ALPHABET = ["a", "é", "ñ", " ", "  ", "\n", " ", "　", "\t", "1", "<", "<|endoftext|>", ",", "'s", "'ll", "字", "😀", "\x85", "\x1c", "B", " the", " "]


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return [*made, "", None, "x" * 20000, " " * 3000, "word " * 4000, made[0], made[0]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(0, 3))
def test_simple8b_round_trip(ids, times):
    ids = np.array(ids * 20**times if times < 3 else ids * 40, np.uint64)
    data = simple8b.encode(ids)
    assert len(data) % 8 == 0 and (simple8b.decode(data) == ids).all() and len(simple8b.decode(data)) == len(ids)


def test_simple8b_blocks_words_and_errors():
    ids = np.arange(3 * simple8b.BLOCK + 5, dtype=np.uint64) % 50000
    data = simple8b.encode(ids)
    for first, last in ((0, 1), (1, 3), (3, 4), (2, 9), (4, 4)):
        assert (simple8b.decode(data, first, last) == ids[first * simple8b.BLOCK : last * simple8b.BLOCK]).all()
    assert len(simple8b.encode(np.ones(60, np.uint64))) == 8 * (4 + 2 + 1)  # one word
    with pytest.raises(ValueError):
        simple8b.decode(b"\0" * 64)


def test_token_files_against_the_library(spark):
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    docs = [(i * 3, t) for i, t in enumerate(texts())]
    shuffled = random.Random(1).sample(docs, len(docs))
    df = spark.createDataFrame([(i, t, "x") for i, t in shuffled], "doc_id long, text string, key string").repartition(7)
    out = new_path(spark, "tokens")
    tokenfiles.write_token_files(df, "doc_id", "text", path, out)
    found = sorted(tokenfiles.read_token_files(spark, out).collect(), key=lambda r: r.doc_id)
    at = 0
    for (i, t), r in zip(docs, found, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = new_path(spark, "tokens")
    tokenfiles.write_token_files(df.limit(0), "doc_id", "text", path, empty)
    assert tokenfiles.read_token_files(spark, empty).collect() == []
    odd = new_path(spark, "tokens")
    tokenfiles.write_token_files(spark.createDataFrame([(None, "b"), (1, "a"), (1, "a")], "doc_id long, text string"), "doc_id", "text", path, odd)
    assert [(r.doc_id, r.start) for r in sorted(tokenfiles.read_token_files(spark, odd).collect(), key=lambda r: r.start)] == [(None, 0), (1, 2), (1, 4)]


def test_token_files_query_leaves_the_tokenizer_as_its_file_defines_it(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    docs = list(enumerate([*texts(), "foo <|endoftext|> bar", "<|endoftext|>", " <|endoftext|><|endoftext|>\n", "after"]))
    path = new_path(spark, "sf")
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{path}/documents.parquet")
    found = sorted(tokenfiles.op5_token_files(spark, path).collect(), key=lambda r: r.doc_id)
    at = 0
    for (i, t), r in zip(docs, found, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_added_tokens_that_are_not_special():
    from tokenizers import AddedToken, Tokenizer

    from textmill.llm.chunks import ChunkEncoder

    tokenizer, own = (Tokenizer.from_file(public.path("byte_bpe_50k.json")) for _ in range(2))
    for t in (tokenizer, own):
        t.add_tokens([AddedToken("cd ef", normalized=False)])
    column = pa.array(["x ab cd efg", " ef", "ab cd", None, " cd", "x cd <|endoftext|>", " ef ef cd"])
    ids, counts = ChunkEncoder(own, added=True).texts(column)
    wanted = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]
    assert counts.tolist() == [len(x) for x in wanted] and ids.tolist() == sum(wanted, [])


def test_byte_bpe_against_the_library(spark):
    import tiktoken

    ranks = bpe.read_ranks(public.path("byte_bpe_50k.tiktoken"))
    wanted = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = dict(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 1) for i, t in docs.items()], "doc_id long, text string, ids int")
    serialised, parts = bpe.tokenizer_json(ranks, public.PATTERN), bpe.token_bytes(ranks)
    for r in bpe.digests(df, serialised, parts).collect():
        ids = wanted.encode_ordinary(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
    some = df.filter("doc_id % 50 = 0")
    decoded = bpe.decode(bpe.encode(some, "text", serialised), "ids", parts)
    assert decoded.columns == ["doc_id", "text", "ids", "decoded"]
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in decoded.collect())
    assert bpe.digests(df.limit(0), serialised, parts).collect() == []


def test_split_characters_and_offsets():
    ranks = {bytes([b]): b for b in range(256)} | {"é".encode(): 256, b"ab": 257}
    parts = bpe.token_bytes(ranks)
    assert bpe.decode_text(parts, [97, 256, 0xF0, 0x9F, 0x98, 0x80]) == "aé😀"
    assert bpe.decode_text(parts, [97, 0xF0, 0x9F]) == "a�"
    assert bpe.character_offsets(parts, [257, 256, 0xF0, 0x9F, 0x98, 0x80, 97]) == [(0, 2), (2, 3), (3, 4), (3, 4), (3, 4), (3, 4), (4, 5)]
    assert sorted(map(ord, bpe.byte_characters()))[:1] == [33] and len(set(bpe.byte_characters())) == 256


def test_words_before_stops_are_encoded_once():
    import public_tokenizers
    from tokenizers import Tokenizer

    from textmill.llm.chunks import ChunkEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = ChunkEncoder(Tokenizer.from_file(path), added=True), Tokenizer.from_file(path)
    texts = ["a word. Or a word, a word! word", "U.S.A.s e.g. don't. x's, 1.5, é. ÷. a÷.b x...y ,a;.b :: \n.", "naïve: Ñ; ß? a.\n\nb.  c .", ".", "", None]
    ids, counts = encoder.texts(pa.array(texts, pa.string()))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert " word" in encoder.place and not any(c.startswith(" word") and c != " word" for c in encoder.place)
