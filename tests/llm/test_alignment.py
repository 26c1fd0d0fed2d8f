import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.llm import alignment
from textmill.llm.perfect_hash import PerfectHash

public = pytest.importorskip("public_tokenizers")
ALPHABET = ["a", "é", "ñ", " ", "  ", "\n", " ", "　", "\t", "1", "<", "<|endoftext|>", "<s>", "<0x41>", ",", "'s", "字", "😀", "\x85", "B", " the", " tokens", "\r", "un", "believ", "able", "▁", "\x00"]


def files():
    with open(public.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        a = f.read()
    with open(public.path("piece_bpe_32k.model"), "rb") as f:
        return a, f.read()


def brute_force(texts):
    """By the libraries themselves, text by text, with plain dictionaries."""
    import json

    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = files()
    tokenizer, model = Tokenizer.from_str(a), SentencePieceProcessor(model_proto=b)
    tokenizer.encode_special_tokens = True
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(p): p for p in prints} | {chr(256 + n): p for n, p in enumerate(p for p in range(256) if p not in prints)}
    a_bytes = {i: bytes(of[c] for c in t) for t, i in json.loads(a)["model"]["vocab"].items() if i != 50256}

    def b_bytes(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    aligned = []
    for text in texts:
        if not text:
            aligned.append(None)
            continue
        x, y = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        p, q = [a_bytes[i] for i in x], [b_bytes(i) for i in y]
        if b"".join(p) != (" " + text).encode() or b"".join(q) != (" " + text).encode():
            aligned.append(None)
            continue
        ends = [set(np.cumsum([len(v) for v in side]).tolist()) for side in (p, q)]
        groups, links, i, j, at = [], [], 0, 0, 0
        for end in sorted(ends[0] & ends[1]):
            own = [[], []]
            for k, (ids, data) in enumerate(((x, p), (y, q))):
                n, pos = (i, j)[k], at
                while pos < end:
                    own[k].append(ids[n])
                    pos += len(data[n])
                    n += 1
                i, j = (n, j) if k == 0 else (i, n)
            at = end
            groups.append("|".join(",".join(map(str, o)) for o in own))
            links.append((own[0][-1], own[1][-1]))
        aligned.append((len(x), len(y), ";".join(groups), links))
    counts = Counter(link for one in aligned if one for link in one[3])
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    rows = []
    for one in aligned:
        if one is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = one
        good = sum(counts[link] == best[link[1]] for link in links)
        rows.append((n_a, n_b, len(links), len(links), good, sum(counts[x] for x in links), groups))
    return rows


def made():
    rng = random.Random(11)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(600)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def test_alignment_against_the_libraries(spark):
    some = made()
    texts = [*some, "", None, " ", "  ", "x ", "▁", "<0x41>", "word " * 3000, "x" * 9000, some[0], some[0]]
    df = spark.createDataFrame([(i // 2, t, "own", i) for i, t in enumerate(texts)], "doc_id long, text string, groups string, n_a int")
    df = df.withColumn("row", F.col("n_a")).repartition(5)
    found = {r.row: r for r in alignment.align(df, *files()).collect()}
    want = brute_force(texts)
    assert len(found) == len(texts)
    for i, row in enumerate(want):
        assert tuple(found[i][c] for c in COLUMNS) == row, texts[i]
        assert found[i].doc_id == i // 2
    assert sum(r[0] == 0 for r in want) > 100 and sum(r[0] > 0 for r in want) > 200


def test_without_cuts_and_in_small_parts_the_groups_are_the_same(monkeypatch):
    texts = made()[:200]
    shown = []
    for cut in (True, False):
        aligner = alignment.Aligner(*files())
        assert aligner.b.may_cut
        aligner.b.may_cut = cut
        monkeypatch.setattr(alignment, "TOKENS_AT_A_TIME", 7 if cut else 1 << 18)
        (a, n_a), (b, n_b) = aligner.encode(pa.array(texts))
        shown.append(aligner.shown(a, n_a, b, n_b, *aligner.common_ends(a, b)).to_pylist())
    assert shown[0] == shown[1] == [r[-1] for r in brute_force(texts)]


def test_tables_without_tokens(spark):
    df = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert [tuple(r[c] for c in COLUMNS) for r in alignment.align(df, *files()).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert alignment.align(df.limit(0), *files()).collect() == []


def test_the_query_digests_the_groups(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = dict(zip(texts, brute_force(list(texts.values())), strict=True))
    found = alignment.op13_alignment(spark, sf).collect()
    assert len(found) == len(texts)
    for r in found:
        *numbers, groups = want[r.doc_id]
        assert [r[c] for c in COLUMNS[:-1]] == numbers
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if numbers[0] else "")


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 63, 5000, 200_000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        hashed = PerfectHash(keys)
        assert sorted(hashed.index(keys).tolist()) == list(range(len(keys)))
        assert (hashed.index(keys ^ np.uint64(1 << 63)) == -1).all()
        assert len(hashed.words) * 64 <= 8 * max(n, 64)
