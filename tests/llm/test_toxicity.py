import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from textmill.llm import gru, toxicity


def test_gradients_are_those_of_differences():
    rng = np.random.default_rng(0)
    net = {k: v.astype(float) for k, v in gru.new_network(5, 3, rng).items()}
    inputs = rng.standard_normal((7, 5))
    inputs[-1] = 0
    windows = rng.integers(0, 6, (4, 6))
    windows[0, 4:] = 6  # padding
    labels = np.array([0.0, 1, 1, 0])
    _, grads, d_inputs = gru.gradients(net, inputs, windows, labels)
    step = 1e-3

    def slope(array, place):
        old = array[place]
        losses = []
        for x in (old + step, old - step):
            array[place] = x
            losses.append(gru.gradients(net, inputs, windows, labels)[0])
        array[place] = old
        return (losses[0] - losses[1]) / 2 / step

    for name, array in net.items():
        place = tuple(int(rng.integers(0, n)) for n in array.shape)
        assert grads[name][place] == pytest.approx(slope(array, place), abs=2e-4), name
    assert d_inputs[2, 3] == pytest.approx(slope(inputs, (2, 3)), abs=2e-4)


def test_windows_overlap_and_cover_every_word():
    edges = np.array([0, 0, 5, 5 + toxicity.WINDOW, 5 + 3 * toxicity.WINDOW + 1])
    places = np.arange(edges[-1])
    windows, owners = toxicity.text_windows(places, edges, 999)
    for text in range(4):
        seen = set(windows[owners == text].reshape(-1).tolist()) - {999}
        assert seen == set(range(edges[text], edges[text + 1]))
    starts = windows[owners == 3][:, 0]
    assert (np.diff(starts) == toxicity.STRIDE).all()


def corpus(rng, n):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(1, 300))]
        toxic = rng.random() < 0.25
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Idiot,", "MORON", "zzq" + word()])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_texts_and_odd_rows(spark):
    rows = corpus(random.Random(1), 900)
    odd = [(5000, None, "a"), (5001, "", "a"), (5002, " \n", "a"), (None, "idiot", "a"), (5003, "word " * 30000 + "idiot", "a"), (3, rows[3][1], "a")]
    docs = spark.createDataFrame([(i, t, "a") for i, t, _ in rows] + odd, "doc_id long, text string, score string")
    labels = [(i, x) for i, _, x in rows] + [(5000, 1), (5001, 0), (7, None), (None, 1), (9, rows[9][2])]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.columns == ["doc_id", "text", "score"]
    found = [(r.doc_id, r.score) for r in scored.collect()]
    assert len(found) == len(rows) + len(odd)
    by_id = {}
    for i, s in found:
        assert 0 <= s <= 1
        assert by_id.setdefault(i, s) == s  # repeated rows score alike
    assert by_id[5000] == by_id[5001] == by_id[5002] == 0
    assert by_id[5003] >= toxicity.THRESHOLD > by_id[None] or by_id[None] >= toxicity.THRESHOLD
    held = [(x, by_id[i]) for i, _, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((s >= toxicity.THRESHOLD) == bool(x) for x, s in held)
    assert right / len(held) >= 0.95
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_one_class_only_scores_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()] == [0.0, 0.0]


def test_scores_do_not_depend_on_the_batch():
    rows = corpus(random.Random(2), 200)
    model = toxicity.train([t for _, t, _ in rows], np.array([x for _, _, x in rows]))
    texts = [t for _, t, _ in rows[:40]]
    together = model.scores(pa.array(texts))
    alone = np.concatenate([model.scores(pa.array([t])) for t in texts])
    assert np.allclose(together, alone, atol=1e-4)


def held_out_scores(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    return {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}


def test_labels_without_documents_take_no_places_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_TOXIC", 100)
    monkeypatch.setattr(toxicity, "TRAIN_CLEAN", 200)
    rows = corpus(random.Random(4), 900)
    labels = [(i, x) for i, _, x in rows] + [(i, i % 2) for i in range(100_000, 130_000)]
    scores = held_out_scores(spark, [(i, t) for i, t, _ in rows] + [(i, " ") for i in range(100_000, 101_000)], labels)
    held = [(x, scores[i]) for i, _, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((s >= toxicity.THRESHOLD) == bool(x) for x, s in held) / len(held) >= 0.9


def test_long_toxic_texts_are_trained_on(spark):
    rng = random.Random(6)
    rows = corpus(rng, 500)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    # every toxic text has about 12,000 characters, with its toxic word among the first ones
    rows = [(i, t + "".join(f" {rng.choice(filler)}" for _ in range(2200)) if x else t, x) for i, t, x in rows]
    scores = held_out_scores(spark, [(i, t) for i, t, _ in rows], [(i, x) for i, _, x in rows])
    toxic = [scores[i] >= toxicity.THRESHOLD for i, _, x in rows if x]
    clean = [scores[i] >= toxicity.THRESHOLD for i, _, x in rows if not x]
    assert min(len(t) for _, t, x in rows if x) > 10_000
    assert sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.1


def test_stretches_cover_texts_up_to_the_bound(spark):
    most, n = toxicity.TRAIN_CHARACTERS, toxicity.TRAIN_STRETCHES
    lengths = [1, most - 1, most, most + 1, 2 * most + 7, n * most, 10 * n * most]
    rows = spark.createDataFrame([(x,) for x in lengths], "length int").select("length", toxicity._stretches(F.col("length")).alias("starts")).collect()
    for r in rows:
        assert len(r.starts) <= n and r.starts[0] == 0 and max(r.starts) + most >= r.length and max(r.starts) <= max(0, r.length - most)
        if r.length <= n * most:
            assert all(b <= a + most for a, b in zip(r.starts, r.starts[1:]))


def test_features_of_many_words_take_little_memory():
    """A worker's memory adds up with its executor's: stretches of words are laid out once, vectors of some words at a time."""
    words = [f"{i * 2654435761 % 2**40:012x}" for i in range(40_000)]
    column = pa.array([" ".join(words)], pa.string())
    model = toxicity.train([], np.empty(0, np.int64))
    tracemalloc.start()
    f = toxicity.Features.of(column)
    at_features = tracemalloc.get_traced_memory()[1] / f.grams.nbytes
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    rows = model.inputs(f)
    at_inputs = (tracemalloc.get_traced_memory()[1] - before - rows.nbytes) / f.grams.nbytes
    tracemalloc.stop()
    assert len(f.grams) == f.counts.sum() and len(rows) == len(words) + 1
    assert at_features < 6 and at_inputs < 2, (at_features, at_inputs)


def test_windows_of_a_training_set_take_little_memory():
    edges = np.array([0, 0, 300_000, 300_001, 800_000])
    places = np.arange(800_000) % 1000
    tracemalloc.start()
    windows, owners = toxicity.text_windows(places, edges, 1000)
    peak = tracemalloc.get_traced_memory()[1] / windows.nbytes
    tracemalloc.stop()
    assert peak < 3, peak
    assert windows[-1][windows[-1] < 1000][-1] == places[-1] and windows[owners == 2].tolist() == [[0] + [1000] * 31]
