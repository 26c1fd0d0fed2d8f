import random
import tracemalloc
import weakref
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from textmill.llm import chunks, minhash


def brute_classes(texts, idf):
    """Smallest index of each component under weighted Jaccard similarity of at least 0.8, over all pairs."""
    hashes, times, counts = minhash.shingles(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    sets = []
    for n, e in zip(counts, ends, strict=True):
        h, t = hashes[e - n : e], times[e - n : e]
        sets.append((h, idf[minhash._df_slot(h)].astype(float) * t))
    head = list(range(len(texts)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    by_shingle = {}
    for i, (h, _) in enumerate(sets):
        for x in h.tolist():
            by_shingle.setdefault(x, []).append(i)
    pairs = {p for own in by_shingle.values() for p in combinations(own, 2)}
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b and minhash.weighted_jaccard(sets[i], sets[j]) >= minhash.SIMILAR:
            head[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rng.randint(5, 200))) for _ in range(120)]
    for base in (0, 1, 2):  # groups of near copies, one of them large, changed more and more
        for k in range(60 if base == 0 else 6):
            words = texts[base].split()
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    passage = " ".join(word() for _ in range(40))
    texts += [f"{' '.join(word() for _ in range(rng.randint(0, 60)))} {passage}" for _ in range(40)]
    texts += ["", None, "one two", "one two", "One  Two", " ", texts[5], texts[5], "x " * 300, "x " * 310]
    return texts


def test_classes_are_those_of_all_pairs(spark):
    texts = corpus(random.Random(3))
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    idf = minhash.inverse_frequencies(df.select("text"))
    want = brute_classes(texts, idf)
    assert len(found) == len(texts)
    wrong = [i for i in range(len(texts)) if found[i] != want[i]]
    assert len(wrong) <= len(texts) // 100  # sampling may miss a link close to the threshold
    assert found[122] == found[121] or want[122] != want[121]


def test_short_empty_null_and_repeated(spark):
    rows = [(3, "a b"), (1, "A  b"), (2, None), (4, ""), (5, "  "), (1, "A  b"), (None, "a b"), (6, "c"), (6, "d e f g h i")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id is None, r.doc_id or 0, r.class_id) for r in minhash.near_duplicates(df).collect())
    assert found == [(False, 1, 1), (False, 1, 1), (False, 2, 2), (False, 3, 1), (False, 4, 4), (False, 5, 5), (False, 6, 6), (False, 6, 6), (True, 0, None)]
    kept = minhash.one_of_each(df).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 1, 2, 4, 5, 6, 6]
    assert minhash.near_duplicates(df.limit(0)).collect() == []


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.random(300).astype(np.float32) + 0.5, rng.random(300).astype(np.float32) + 0.5
    b[200:] = a[200:]
    picked = minhash.samples(np.concatenate([h[:250], h[50:]]), np.concatenate([a[:250], b[50:]]), np.array([250, 250]), 2000)
    want = minhash.weighted_jaccard((h[:250], a[:250]), (h[50:], b[50:]))
    assert (picked[0] == picked[1]).mean() == pytest.approx(want, abs=0.04)


def signed(spark, texts):
    """(nodes, whole, broadcast idf, sets) for texts that are all different and alone in their components."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    idf = minhash.inverse_frequencies(df.select("text"))
    hashes, times, counts = minhash.shingles(pa.array(texts, pa.string()))
    names, at, rows, whole, sets = minhash.digests(hashes, times, counts), 0, [], [], []
    for name, n in zip(names, counts.tolist(), strict=True):
        h, t = hashes[at : at + n], times[at : at + n]
        at += n
        w = idf[minhash._df_slot(h)].astype(float) * t
        order = np.argsort(h)
        rows.append((name, name, float(w.sum())))
        whole.append((name, bytearray(h[order].tobytes()), bytearray(t[order].astype(np.uint32).tobytes())))
        sets.append((h, w))
    nodes = spark.createDataFrame(rows, "node string, component string, weight double")
    held = spark.createDataFrame(whole, "node string, hashes binary, times binary")
    return nodes, held, spark.sparkContext.broadcast(idf), dict(zip(names, sets, strict=True))


def test_prefixes_find_all_similar_pairs_and_no_pair_of_a_shared_passage(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    passage = " ".join(word() for _ in range(80))
    # a quarter of each text is its own: similarities of about 0.7
    around = [f"{' '.join(word() for _ in range(17))} {passage}" for _ in range(150)]
    edited = []
    base = [word() for _ in range(120)]
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = word()
        edited.append(" ".join(words[rng.randint(0, 12):]))
    nodes, whole, idf, sets = signed(spark, sorted({*around, *edited}))
    side, prefixes = minhash.postings(nodes, whole, idf, minhash.SIMILAR)
    found = {(r.a, r.b) for r in minhash.all_pairs(side, prefixes, minhash.SIMILAR).collect()}
    similar = {(a, b) for a, b in combinations(sorted(sets), 2) if minhash.weighted_jaccard(sets[a], sets[b]) >= minhash.SIMILAR}
    assert len(similar) > 50 and similar <= found
    assert {(r.a, r.b) for r in minhash.centre_pairs(side, minhash.SIMILAR).collect()} <= found
    shared = {minhash.digests(*minhash.shingles(pa.array([t])))[0] for t in around}
    assert not [p for p in found if set(p) <= shared]


def test_large_group_around_a_passage_and_very_long_texts(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    passage = " ".join(word() for _ in range(100))
    texts = [f"{passage} {' '.join(word() for _ in range(rng.randint(28, 40)))}" for _ in range(600)]
    long = [word() for _ in range(120_000)]
    texts += [" ".join(long), " ".join([*long[:60_000], "other", *long[60_000:]]), passage, passage + " end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    idf = minhash.inverse_frequencies(df.select("text"))
    sample = [*range(200), *range(600, 604)]
    want = brute_classes([texts[i] for i in sample], idf)
    assert [found[i] for i in sample] == [sample[k] for k in want]
    assert len(set(found.values())) == 602


def test_tasks_take_texts_in_small_pieces():
    """What a task holds beside its batch does not grow with the batch."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    idf = SimpleNamespace(value=np.ones(1 << minhash.DF_BITS, np.float32))
    tracemalloc.start()
    n = sum(b.num_rows for b in minhash._sign(idf)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1500 and peak < 80e6, peak


def test_workers_give_back_memory_when_a_task_has_ended(monkeypatch):
    seen, held = [], []

    def work(batches):
        for b in batches:
            data = np.ones(1000)
            held.append(weakref.ref(data))
            yield b
    monkeypatch.setattr(chunks, "give_back", lambda: seen.append([r() is None for r in held]))
    rows = chunks.giving_back(work)(iter([1, 2]))
    assert next(rows) == 1 and not seen
    assert list(rows) == [2] and seen == [[True, True]]
