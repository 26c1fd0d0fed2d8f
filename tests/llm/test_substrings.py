import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import zstandard

from textmill.llm import substrings
from textmill.llm.suffixes import deep_shallow


def brute(docs):
    """(n_bytes, n_removed, n_spans, sha) per row, by all strings of 50 bytes."""
    first = {}
    for key, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            if key is not None:
                s = data[i : i + 50]
                first[s] = min(first.get(s, key), key)
    out = []
    for key, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if key is not None and first[data[i : i + 50]] < key:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        out.append((key, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (9, 14, 20, 40, 80)]
    docs = []
    for key in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(prose(rng.randint(0, 30)))
            if rng.random() < 0.5:
                text = rng.choice(shared)
                a = rng.randint(0, 30) if rng.random() < 0.3 else 0
                parts.append(text[a:])
        docs.append((key, "".join(parts)))
    docs += [(200 + k, "x" * n) for k, n in enumerate((49, 50, 51, 120, 300))]
    docs += [(300 + k, "ab" * n) for k, n in enumerate((40, 25, 24))]
    docs += [(400, "\0" * 60), (401, "\0" * 55), (402, "\0" * 49), (403, None), (404, ""), (405, docs[3][1]), (405, docs[7][1]), (3, docs[3][1])]
    docs += [(None, docs[10][1]), (None, None), (-5, docs[20][1][:80])]
    rng.shuffle(docs)
    return docs


def run(spark, docs, monkeypatch=None, **options):
    df = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, bundle int").repartition(5)
    rows = substrings.deduplicate(df, **options).collect()
    for r in rows:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str)


def test_as_all_strings_of_fifty_bytes(spark):
    docs = corpus(random.Random(1))
    assert run(spark, docs) == sorted(brute(docs), key=str)


def test_hot_anchors_as_well(spark):
    docs = corpus(random.Random(2))
    assert run(spark, docs, hot_documents=2) == sorted(brute(docs), key=str)


def test_anchors_in_many_places_as_well(spark):
    docs = corpus(random.Random(5))
    assert run(spark, docs, hot_places=3) == sorted(brute(docs), key=str)


def test_long_runs_in_different_texts(spark):
    n = 1 << 20
    docs = [(1, "a" * 70 + "x" * 2 * n + "tail"), (2, "head" + "x" * 3 * n), (3, "ab" * n), (4, "cc" + "ba" * (n // 2) + "x" * 49), (5, "abc" * 60)]
    assert run(spark, docs) == sorted(brute(docs), key=str)


def test_surroundings_of_a_long_run_take_little_memory():
    text = b"x" * (1 << 20)
    own = substrings.Bundle([1], [len(text)], zstandard.compress(text))
    _, _, hashes = own.anchors(np.zeros(1, bool))
    assert len(hashes) == len(text) - substrings.ANCHOR + 1
    number = substrings._packed(hashes[:1] & np.uint64(0xFFFFFFFF), "<u4")
    part = int(substrings._ranges(hashes[:1], 4)[0])
    bundles = pa.table({"bundle": [0], "ids": [[1]], "sizes": [[len(text)]], "texts": [zstandard.compress(text)], "copies": pa.array([None], pa.list_(pa.int32()))})
    for hot, work in ((0, substrings._surround(4)), (1, substrings._hot_windows(4))):
        replies = pa.table({"bundle": [0], "part": [part], "numbers": [number], "hot": [substrings._packed(np.array([hot]), "u1")], "any_hot": [bool(hot)]})
        tracemalloc.start()
        found = work(bundles, replies)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert 0 < found.num_rows <= 1 + len(text) // substrings.AT_A_TIME and peak < 300 << 20


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.deduplicate(df).collect() == []


def test_deep_shallow_orders_and_groups():
    rng = np.random.default_rng(4)
    for n, letters in ((0, 2), (1, 2), (50, 2), (3000, 2), (3000, 200)):
        strings = rng.integers(0, letters, (n, 50)).astype(np.uint8)
        strings[n // 2 :, :40] = 7  # long common prefixes
        strings[n // 3 : n // 2] = strings[: n // 2 - n // 3]
        order, first = deep_shallow(strings)
        rows = [s.tobytes() for s in strings]
        assert [rows[i] for i in order] == sorted(rows)
        assert len(set(first.tolist())) == len(set(rows))
        assert all(rows[order[f]] == r for f, r in zip(first.tolist(), rows, strict=True))


def test_ranges_grow_with_the_table(spark, monkeypatch):
    # a task of a range holds the anchors of so many bundles, however many there are
    monkeypatch.setattr(substrings, "BUNDLE_BYTES", 200)
    monkeypatch.setattr(substrings, "RANGE_BUNDLES", 2)
    asked, offer = [], substrings._offer
    monkeypatch.setattr(substrings, "_offer", lambda n: asked.append(n) or offer(n))
    docs = corpus(random.Random(8))[:60]
    rows = substrings.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)
    assert got == sorted((str(x[0]), *x[1:]) for x in brute(docs))
    assert asked[0] > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
