import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.functions import tokens
from textmill.operators import blocks, classify, clustering, evaluate, features, grams, keywords, labelling, similarity, skew
from textmill.operators import linkage as linkages
from textmill.operators.components import connected_components
from textmill.plans import labelling as label_runs
from textmill.plans import training


def texts_of(n, seed, vocabulary=30, most=8):
    rng = random.Random(seed)
    pick = lambda: " ".join(f"w{min(int(rng.expovariate(0.15)), vocabulary)}" for _ in range(rng.randint(0, most)))
    texts = [pick() for _ in range(n)]
    # a third of all rows are copies of one text
    return [texts[0] if i % 3 == 0 else t for i, t in enumerate(texts)]


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return 1.0 - len(a & b) / len(a | b) if a | b else 0.0


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_idx long, text string")


@pytest.mark.parametrize("limit", [0.3, 0.7])
def test_near_pairs_equal_brute_force(spark, limit):
    texts = texts_of(60, 1)
    df = frame(spark, texts)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(frozenset(t.split()), i)
    want = {
        (i, j): round(jaccard(texts[i], texts[j]), 9)
        for i, j in itertools.combinations(sorted(first.values()), 2)
        if jaccard(texts[i], texts[j]) <= limit + 1e-9
    }
    got = similarity.near_pairs(df, "text", limit).collect()
    assert {(r["i"], r["j"]): round(r["distance"], 9) for r in got} == want
    members = {r["row_idx"]: r["gid"] for r in similarity.set_members(df, "text").collect()}
    assert members == {i: first[frozenset(t.split())] for i, t in enumerate(texts)}


@pytest.mark.parametrize("limit", [0.3, 0.8])
def test_near_pairs_met_in_blocks(spark, limit, monkeypatch):
    # several blocks and portions; the words of a pair are counted in a task, and no pair is shuffled for each word
    monkeypatch.setattr(blocks, "LEAST_ITEMS", 40)
    monkeypatch.setattr(blocks, "MATCHES", 64)
    texts = texts_of(90, 4, vocabulary=40, most=12)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(frozenset(t.split()), i)
    want = {(i, j) for i, j in itertools.combinations(sorted(first.values()), 2) if jaccard(texts[i], texts[j]) <= limit + 1e-9}
    found = similarity.near_pairs(frame(spark, texts), "text", limit)
    assert {(r["i"], r["j"]) for r in found.collect()} == want
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_all_pairs_equal_brute_force(spark, monkeypatch):
    # those further apart than 0.8, without a common word and between copies too; together they stand for all pairs of rows
    monkeypatch.setattr(blocks, "LEAST_ITEMS", 60)
    monkeypatch.setattr(blocks, "ASKED_ROWS", 7)
    texts = texts_of(40, 6, vocabulary=60) + ["", None, "no other holds these"]
    first, copies = {}, {}
    for i, t in enumerate(texts):
        first.setdefault(frozenset((t or "").split()), i)
    for t in texts:
        gid = first[frozenset((t or "").split())]
        copies[gid] = copies.get(gid, 0) + 1
    want = {(i, j): (round(jaccard(texts[i] or "", texts[j] or ""), 9), copies[i], copies[j]) for i, j in itertools.combinations(sorted(copies), 2)}
    want |= {(i, i): (0.0, n, n) for i, n in copies.items() if n > 1}
    got = similarity.all_pairs(frame(spark, texts), "text").collect()
    assert {(r["i"], r["j"]): (round(r["distance"], 9), r["copies_i"], r["copies_j"]) for r in got} == want and len(got) == len(want)
    rows = sum(r["copies_i"] * r["copies_j"] if r["i"] < r["j"] else r["copies_i"] * (r["copies_i"] - 1) // 2 for r in got)
    assert rows == len(texts) * (len(texts) - 1) // 2


def test_naive_bayes_shuffles_tokens_once(spark):
    rows = spark.createDataFrame([(0, "a b b", 0), (1, "b c", 2), (2, "a c c c", None)], "row_idx long, text string, target int")
    model = classify.fit_naive_bayes(rows, "text")
    assert {(r["token"], r["target"], r["n"]) for r in model.tokens.collect()} == {
        ("a", 0, 1), ("b", 0, 2), ("b", 2, 1), ("c", 2, 1), ("a", None, 1), ("c", None, 3)
    }
    assert model.classes.select("vocabulary").distinct().first()[0] == 3
    # looked up as written, without an aggregate of their own
    known = classify.fit_naive_bayes(rows.filter("target IS NOT NULL"), "text")
    scores = classify.naive_bayes_scores(known, rows, "text")
    assert "collect_list" not in scores._jdf.queryExecution().executedPlan().toString()
    assert scores.count() == 3


@pytest.mark.parametrize("ngram", ["unigram", "bigram", "trigram"])
@pytest.mark.parametrize("binary", [False, True])
def test_grams_counted_in_tasks_equal_those_of_columns(spark, ngram, binary, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "b", "a_b", "b_a", "É", "_"]) for _ in range(rng.randint(0, 9))) for _ in range(40)] + ["", None, " a "]
    df = frame(spark, texts).withColumn("target", F.expr("CASE row_idx % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 END"))
    of_row = tokens.ngrams(tokens.words(F.col("text")), ngram)
    listed = df.select("row_idx", "target", F.explode(F.array_distinct(of_row) if binary else of_row).alias("token"))
    want = sorted(map(tuple, listed.groupBy("row_idx", "token").count().collect()))
    assert sorted(map(tuple, grams.row_tokens(df, "text", ngram, binary, "row_idx").collect())) == want
    counts = sorted(map(repr, listed.groupBy("target", "token").count().collect()))
    summed = grams.class_tokens(df, "text", "target", ngram, binary).groupBy("target", "token").agg(F.sum("n").alias("count"))
    assert sorted(map(repr, summed.collect())) == counts
    # the same in small portions
    monkeypatch.setattr(grams, "PORTION_WORDS", 10)
    words = [(t or "").lower().split() for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(range(len(words)))], names=["words", "id"])
    cut = list(grams.portions(iter([batch])))
    found = [(part["id"][row].as_py(), g.strings[i].as_py(), n) for part in cut for g in [grams.Grams(part["words"], ngram)]
             for row, i, n in zip(*(x.tolist() for x in g.counts(np.arange(part.num_rows), binary)))]
    assert sorted(found) == want and len(cut) > 10


def test_naive_bayes_explodes_no_grams(spark):
    rows = spark.createDataFrame([(0, "a b b", 0), (1, "b c", 2)], "row_idx long, text string, target int")
    model = classify.fit_naive_bayes(rows, "text", ngram="trigram")
    scores = classify.naive_bayes_scores(model, rows, "text")
    assert "Generate" not in scores._jdf.queryExecution().executedPlan().toString()


def test_neighbours_equal_brute_force(spark):
    base, asked = texts_of(40, 2), texts_of(15, 3) + ["unseen words only", ""]
    target = [(0, 2, 4)[i % 3] for i in range(len(base))]
    train = frame(spark, base).join(spark.createDataFrame(list(enumerate(target)), "row_idx long, target int"), "row_idx")
    model = classify.fit_neighbours(train, "text", k=4)
    got = classify.nearest_neighbours(model, frame(spark, asked), "text").orderBy("row_idx", "rank").collect()
    found = {}
    for r in got:
        found.setdefault(r["row_idx"], []).append((round(r["distance"], 9), r["target"], r["neighbour"]))
    for i, text in enumerate(asked):
        want = sorted((round(jaccard(text, b), 9), target[j], j) for j, b in enumerate(base))[:4]
        assert found[i] == want


def flat_clusters(texts, k, linkage, max_distance=1.0):
    """Naive merging, one nearest pair at a time, then the cut used by flat clusters of at most k.

    Texts further apart than ``max_distance`` lie at distance 1.
    """
    apart = lambda x, y: d if (d := jaccard(x, y)) <= max_distance else 1.0
    groups, heights = [[i] for i in range(len(texts))], []
    join = (lambda d: sum(d) / len(d)) if linkage == "average" else max
    history = [list(map(tuple, groups))]
    while len(groups) > 1:
        best = min(
            ((round(join([apart(texts[x], texts[y]) for x in a for y in b]), 9), min(a), min(b), ia, ib)
             for (ia, a), (ib, b) in itertools.combinations(enumerate(groups), 2)),
        )
        h, _, _, ia, ib = best
        groups[ia] = groups[ia] + groups[ib]
        del groups[ib]
        heights.append(h)
        history.append([tuple(sorted(g)) for g in groups])
    cut = sorted(heights, reverse=True)[k - 1]
    applied = sum(h <= cut for h in heights)
    return {frozenset(g) for g in history[applied]}


@pytest.mark.parametrize("linkage", ["average", "complete"])
@pytest.mark.parametrize("max_distance, k", [(0.95, 3), (0.6, 6), (0.6, 3)])
def test_hierarchical_equals_naive_merging(spark, linkage, max_distance, k):
    rng = random.Random(5)
    # distinct pair similarities: long sets from one small vocabulary
    texts = [" ".join(rng.sample([f"w{i}" for i in range(40)], rng.randint(8, 30))) for _ in range(12)]
    texts += texts[:2]
    got = clustering.hierarchical(frame(spark, texts), "text", k, linkage, max_distance=max_distance).collect()
    clusters = {}
    for r in got:
        clusters.setdefault(r["cluster"], set()).add(r["row_idx"])
    assert {frozenset(c) for c in clusters.values()} == flat_clusters(texts, k, linkage, max_distance)
    assert all(min(c) == name for name, c in clusters.items())


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 20)] + [(30, 35), (35, 32)] + [(50, j) for j in range(51, 60)]
    nodes = spark.createDataFrame([(i,) for i in range(61)], "node long")
    got = {r["node"]: r["component"] for r in connected_components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(21)} == {0}
    assert got[35] == got[32] == 30 and got[33] == 33
    assert {got[i] for i in range(50, 60)} == {50}


def test_balanced_joins_equal_plain_joins(spark):
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("k"), "id")
    table = spark.range(0, 35).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = sorted(map(tuple, df.join(table, "k").select("k", "id", "v").collect()))
    assert sorted(map(tuple, skew.lookup_join(df, table, "k").select("k", "id", "v").collect())) == want
    pairs = skew.salted_pairs(df, df, "k", skew.self_sizes(df, "k"), F.col("a.id") < F.col("b.id"), rows_per_task=10)
    plain = df.alias("a").join(df.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id")))
    ids = lambda j: sorted(map(tuple, j.select("a.id", "b.id").collect()))
    assert ids(pairs) == ids(plain)


def test_every_heavy_key_is_cut(spark):
    # more than a thousand keys above the limit: no block of any of them holds more than a few rows too many
    df = spark.range(1200 * 12).select((F.col("id") % 1200).alias("k"), "id")
    cut = skew._in_blocks(df, "k", skew.self_sizes(df, "k"), "n_left", "n_right", 2)
    blocks = cut.groupBy("k", "__own", "__other").count()
    assert blocks.select("k").distinct().count() == 1200
    assert blocks.filter("count > 9").count() == 0 and blocks.groupBy("k").agg(F.countDistinct("__other").alias("n")).filter("n <> 6").count() == 0
    pairs = skew.salted_pairs(df, df, "k", skew.self_sizes(df, "k"), F.col("a.id") < F.col("b.id"), rows_per_task=2)
    assert pairs.count() == 1200 * 66


def test_mapping_of_many_labels():
    rng = random.Random(4)
    labels, ids = list(range(4)), list(range(6))
    hits = {(a, c): rng.randint(0, 5) for a in labels for c in ids}
    best = max(itertools.permutations(ids, 4), key=lambda m: sum(hits[pair] for pair in zip(labels, m)))
    assert labelling.best_mapping(labels, ids, hits) == dict(zip(labels, best))
    many = labelling.best_mapping(list(range(8)), list(range(64)), {(k, 9 * k): 5 for k in range(8)})
    assert many == {k: 9 * k for k in range(8)}


def test_mappings_of_forty_labels_and_against_all_permutations():
    rng = random.Random(6)
    for _ in range(150):
        labels, ids = list(range(rng.randint(1, 5))), list(range(rng.randint(1, 6)))
        hits = {(a, c): rng.randint(0, 3) for a in labels for c in ids if rng.random() < 0.8}
        slots = [*ids, *[None] * max(0, len(labels) - len(ids))]
        # on a tie the first labels get the smallest places
        best = max(itertools.permutations(range(len(slots)), len(labels)), key=lambda m: (sum(hits.get((a, slots[p]), 0) for a, p in zip(labels, m)), [-p for p in m]))
        assert labelling.best_mapping(labels, ids, hits) == {a: slots[p] for a, p in zip(labels, best) if slots[p] is not None}
    places = rng.sample(range(200), 40)
    hits = {(k, p): 9 for k, p in enumerate(places)} | {(k, c): rng.randint(0, 4) for k in range(40) for c in range(200) if c not in places}
    assert labelling.best_mapping(list(range(40)), list(range(200)), hits) == dict(enumerate(places))


def test_thousands_of_labels(spark):
    n = 2000
    df = spark.range(n * 3).select((F.col("id") % n).cast("int").alias("actual"), F.when(F.col("id") < n, 0).otherwise(F.col("id") % n).cast("int").alias("predicted"))
    cells = evaluate.confusion_matrix(df, "actual", "predicted")
    assert cells.count() == n * n and cells.agg(F.sum("n")).first()[0] == n * 3
    assert round(evaluate.accuracy_error(df).first().accuracy, 6) == round((2 * n + 1) / (3 * n), 6)
    per = {r.label: r for r in evaluate.per_label(df).collect()}
    assert len(per) == n and per[7].recall == 2 / 3 and per[7].precision == 1.0 and per[0].precision == 3 / (n + 2)


def test_dbscan_equals_brute_force_for_any_eps(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["apple", "pear", "plum", "fig", "kiwi", "lime"]) for _ in range(rng.randint(1, 4))) for _ in range(40)] + ["", "!", "the"]
    df = frame(spark, texts)
    weights = {}
    for r in features.tfidf(df, "text").collect():
        weights.setdefault(r["row_idx"], {})[r["term"]] = r["weight"]
    vector = [weights.get(i, {}) for i in range(len(texts))]
    far = lambda a, b: max(0.0, sum(a.get(t, 0) ** 2 + b.get(t, 0) ** 2 - 2 * a.get(t, 0) * b.get(t, 0) for t in {*a, *b})) ** 0.5
    for eps in (0.5, 1.0, 1.2, 1.5):
        near = [[j for j, b in enumerate(vector) if far(a, b) <= eps + 1e-9] for a in vector]
        core = {i for i, n in enumerate(near) if len(n) >= 5}
        want = [-1] * len(texts)
        for i in sorted(core):
            if want[i] == -1:
                todo, want[i] = [i], i
                while todo:
                    for j in near[todo.pop()]:
                        if j in core and want[j] == -1:
                            want[j] = i
                            todo.append(j)
        for i in set(range(len(texts))) - core:
            want[i] = min((want[j] for j in near[i] if j in core), default=-1)
        got = {r["row_idx"]: r["cluster"] for r in clustering.dbscan(df, "text", eps).collect()}
        assert [got[i] for i in range(len(texts))] == want, eps


def test_counts_inside_the_row(spark):
    df = spark.createDataFrame([(1, "b a b c b"), (2, ""), (3, None)], "row_idx long, text string")
    got = sorted(map(tuple, features.term_counts(df, "text").collect()))
    assert got == [(1, "a", 1), (1, "b", 3), (1, "c", 1)]


def test_runs_are_stored_and_found_again(spark, tmp_path):
    rows = [(i, ("good fine day and more of it", "bad sad night and more of it", "plain table and more of it")[i % 3] + f" x{i}", (4, 0, 2)[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_idx long, text string, target int")
    df.write.parquet(f"{tmp_path}/labelled")
    artefacts = spark.createDataFrame([(None, "", f"{tmp_path}/labelled")], "original_file string, cleaned_file string, labeled_file string")
    store = f"{tmp_path}/store"
    with pytest.raises(ValueError):
        training.predict_latest(spark, store, "s", df)
    sad = spark.createDataFrame([(0, "a sad bad night and more of it")], "row_idx long, text string")
    options = {"naive_automatic": {"positives": ["good"], "negatives": ["bad"]}, "decision_tree": {"max_depth": 4}}
    for minute, algorithm in enumerate(("naive_automatic", "knn", "decision_tree", "naive_bayes")):
        training.train_and_store(artefacts, store, "s", algorithm, f"2025-01-01 00:0{minute}:00", **options.get(algorithm, {}))
        assert training.predict_latest(spark, store, "s", sad).predictions.first()["predicted"] == 0
        assert training.evaluation_report(training.read_runs(spark, store)).first()["algorithm"] == algorithm
    bad = spark.createDataFrame([(0, "a long enough text without label", "x")], "row_idx long, text string, target string")
    result = training.predict_latest(spark, store, "s", bad)
    assert result.metrics is None and "target" in result.error
    with pytest.raises(ValueError, match="no text column"):
        training.predict_dataset(None, spark.createDataFrame([(0, "ab")], "row_idx long, short string"))


def test_labelling_runs(spark):
    df = frame(spark, ["love this long text", "bad and long text", "nothing to see here"])
    run = label_runs.label_with_keywords(df, {"positive": ["love"], "negative": ["bad"]})
    assert run.text == "text" and [r["target"] for r in run.preview.collect()] == [4, 0, 2] and run.summary.first()["labeled"] == 2
    lists = {"negative": spark.createDataFrame([("nothing",)], "word string")}
    assert label_runs.label_with_keywords(df, None, lists).summary.first()["label_0"] == 1
    with pytest.raises(ValueError):
        label_runs.label_with_keywords(df)
    clusters = label_runs.label_with_clusters(df, "dbscan", min_samples=1)
    assert sorted(r["target"] for r in clusters.data.collect()) == [0, 2, 4]
    notes = spark.createDataFrame([(1, 0, 4)], "seq int, row_idx long, label int")
    assert label_runs.label_with_annotations(df, notes, stop_early=True).data.count() == 1


def test_keyword_ties_differ(spark):
    df = spark.createDataFrame([("love bad",), ("so bad",), ("nothing",), (None,)], "t string")
    words = {"pos": ["love"], "neg": ["bad"]}
    assert [r[0] for r in df.select(labelling.label_by_keywords(F.col("t"), words)).collect()] == [4, 0, 2, 2]
    got = df.select(labelling.classify_by_keywords(F.col("t"), ["love"], ["bad"])).collect()
    assert [r[0] for r in got] == [2, 0, 2, 2]


def test_manual_labels_last_wins(spark):
    df = spark.range(4).select(F.col("id").alias("row_idx"))
    notes = spark.createDataFrame([(1, 0, 0), (2, 0, 4), (3, 9, 2), (4, 2, 2)], "seq int, row_idx long, label int")
    got = {r["row_idx"]: r["target"] for r in labelling.label_manual(df, notes).collect()}
    assert got == {0: 4, 1: -1, 2: 2, 3: -1}
    assert labelling.label_manual(df, notes, stop_early=True).count() == 2


def test_alignment_and_cluster_labels(spark):
    pairs = list(zip([0, 0, 4, 4, 2, 2], [1, 1, 2, 2, 0, 0]))
    df = spark.createDataFrame(pairs, "actual int, cluster int")
    assert all(r["actual"] == r["aligned"] for r in labelling.align_clusters(df, "actual", "cluster").collect())
    few = spark.createDataFrame([(0, 7), (2, 7), (2, 7), (4, 7)], "actual int, cluster int")
    assert {r["aligned"] for r in labelling.align_clusters(few, "actual", "cluster").collect()} == {2}
    ids = spark.createDataFrame([(0,), (1,), (-1,), (2,), (3,)], "cluster int")
    got = {r["cluster"]: r["target"] for r in labelling.label_clusters(ids).collect()}
    assert got == {0: 0, 1: 2, -1: 2, 2: 4, 3: 2}


def test_split_is_a_partition_and_refuses_small_input(spark):
    df = spark.range(500).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 3 > 0, 4).otherwise(0).alias("target"))
    sizes = {(r[0], r[1]): r["count"] for r in classify.stratified_split(df).groupBy("target", "is_validation").count().collect()}
    assert sizes == {(0, True): 33, (0, False): 134, (4, True): 67, (4, False): 266}
    with pytest.raises(ValueError):
        classify.check_split(df.limit(3), test_size=0.2)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "actual int, predicted int")
    report = evaluate.metric_report(df).first()
    assert report["accuracy"] == 0.75 and report["error_rate"] == 0.25
    assert round(report["precision"], 6) == round((2 / 3 + 1) / 2, 6)
    assert [tuple(c) for c in report["confusion_matrix"]] == [(0, 0, 2), (0, 1, 0), (1, 0, 1), (1, 1, 1)]
    assert evaluate.rand_index(df).first()[0] == 0.5
    assert evaluate.metric_report(df.limit(0)).first()["accuracy"] is None


def test_training_run_and_prediction(spark):
    rows = [(i, ("good fine day", "bad sad night", "plain table")[i % 3] + f" x{i}", (4, 0, 2)[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_idx long, text string, target int")
    for algorithm, params in (("naive_bayes", {}), ("decision_tree", {"max_depth": 4})):
        run = training.train(df, algorithm, **params)
        assert run.metrics.first()["accuracy"] == 1.0
    run = training.train(df, "naive_bayes")
    result = training.predict_dataset(run.model, df.drop("target"))
    assert result.metrics is None and result.distribution.first()["total"] == 60
    one = spark.createDataFrame([(0, "a sad bad day")], "row_idx long, text string")
    assert training.predict_texts(run.model, one).first()["predicted"] == 0


def test_a_training_run_scores_once(spark):
    rows = [(i, ("good fine day", "bad sad night")[i % 2] + f" x{i}", (4, 0)[i % 2]) for i in range(40)]
    run = training.train(spark.createDataFrame(rows, "row_idx long, text string, target int"), "naive_bayes")
    # predictions and metrics read what was written
    assert "Join" not in run.predictions._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in run.metrics._jdf.queryExecution().toString()
    assert run.predictions.count() == 8


def test_keyword_tables_equal_keyword_lists(spark):
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abcÉ ") for _ in range(n))
    texts = [word(rng.randint(0, 40)) for _ in range(200)] + [None, "", "a", "ab" * 20_000]
    lists = {"negatives": [word(rng.randint(1, 5)) for _ in range(60)], "positives": [word(rng.randint(2, 6)) for _ in range(60)], "x": ["", "b"]}
    df = frame(spark, texts)
    tables = {k: spark.createDataFrame([(w,) for w in [*v, None, v[0]]], "word string") for k, v in lists.items()}
    got = {r.row_idx: r.target for r in labelling.label_by_keyword_tables(df, "text", tables).collect()}
    distinct = {k: sorted({w.lower() for w in v} - {""}) for k, v in lists.items()}
    want = {r.row_idx: r.target for r in df.select("row_idx", labelling.label_by_keywords(F.col("text"), distinct).alias("target")).collect()}
    assert got == want and len(set(want.values())) == 3
    found = {(r.row_idx, r.word) for r in labelling.keyword_matches(df, "text", tables["positives"]).collect()}
    assert found == {(i, w) for i, t in enumerate(texts) for w in distinct["positives"] if w in (t or "").lower()}


def test_a_large_keyword_table_is_no_part_of_the_plan(spark):
    words = spark.range(50_000).select(F.concat(F.lit("word"), F.col("id")).alias("word"))
    df = frame(spark, ["there is word49999 here", "no such thing"])
    labelled = labelling.label_by_keyword_tables(df, "text", {"pos": words})
    assert "word49999" not in labelled._jdf.queryExecution().toString()
    assert [r.target for r in labelled.orderBy("row_idx").collect()] == [4, 2]


def test_keyword_tables_meet_texts_in_blocks(spark, monkeypatch):
    for name, value in (("TEXT_BYTES", 2000), ("LEAST_BYTES", 500), ("WORD_BYTES", 100), ("WALKED_BYTES", 300), ("CELLS", 90), ("DEPTH", 4)):
        monkeypatch.setattr(keywords, name, value)
    rng = random.Random(29)
    word = lambda n: "".join(rng.choice("aaabÉ ") for _ in range(n))
    texts = [word(rng.randint(0, 60)) for _ in range(300)] + ["", None, "a" * 5000]
    words = sorted({word(rng.randint(1, 9)) for _ in range(150)})
    found = labelling.keyword_matches(frame(spark, texts), "text", spark.createDataFrame([(w,) for w in words], "word string"))
    want = sorted({(i, w.lower()) for i, t in enumerate(texts) for w in words if w.lower() in (t or "").lower()})
    assert sorted((r.row_idx, r.word) for r in found.collect()) == want
    lowered, listed = ([(x or "").lower() for x in xs] for xs in (texts, words))
    tree = keywords.WordTree(pa.chunked_array([listed]))
    held = [(at + i, listed[j]) for at, seen in tree.held(*keywords.joined_bytes(pa.chunked_array([lowered[:7], lowered[7:]]))) for i, j in zip(*np.nonzero(seen))]
    assert sorted(held) == want and max(map(len, listed)) > keywords.DEPTH
    # neither stretches of texts nor pairs of a text and a word that may be in it become rows
    plan = labelling.label_by_keyword_tables(frame(spark, texts), "text", {"pos": spark.range(3).select(F.col("id").cast("string").alias("word"))})
    assert "contains" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()


def _blocks_of(rows):
    lists = pa.array(rows, pa.list_(pa.int32()))
    return blocks.Block.of(pa.table({"ids": lists}), "ids")


def test_nearest_rows_in_portions_equal_brute_force(monkeypatch):
    for name, value in (("FREQUENT", 4), ("ASKED_ROWS", 5), ("HELD_ROWS", 7)):
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(3)
    draw = lambda n: [sorted(set(rng.integers(0, 30, rng.integers(1, 12)).tolist())) for _ in range(n)]
    asked, held = [*draw(23), [99]], draw(40)
    sizes = [np.array([len(x) for x in rows]) for rows in (asked, held)]
    got = {}
    for i, j, distance in blocks.nearest_rows(_blocks_of(asked), _blocks_of(held), *sizes, 3):
        for a, b, d in zip(i.tolist(), j.tolist(), distance.tolist()):
            got.setdefault(a, []).append((d, b))
    for i, x in enumerate(asked):
        apart = [(1.0 - len({*x} & {*y}) / len({*x} | {*y}), j) for j, y in enumerate(held) if {*x} & {*y}]
        assert sorted(got.get(i, [])) == sorted(apart)[:3]


def test_neighbours_send_no_more_than_k_sets_of_a_block(spark):
    base = frame(spark, texts_of(60, 4)).withColumn("target", F.lit(0))
    model = classify.fit_neighbours(base, "text", k=2)
    _, sets = classify._query_sets(frame(spark, texts_of(9, 5)), "text", "row_idx")
    asked = classify._word_numbers(sets, "q", model.frequencies).join(sets.select("q", "size"), "q")
    near = classify._nearest_sets(model, asked.withColumn("q", F.monotonically_increasing_id()))
    assert near.groupBy("q").count().agg(F.max("count")).first()[0] <= 2


@pytest.mark.parametrize("min_dot", [0.5, 0.875])
def test_near_rows_in_portions_equal_brute_force(monkeypatch, min_dot):
    for name, value in (("SKETCH", 4), ("SKETCHED_ROWS", 6), ("MATCHES", 20)):
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(5)
    rows = [sorted(set(rng.integers(0, 9, rng.integers(1, 7)).tolist())) for _ in range(50)]
    weights = [(w := rng.random(len(x))) / np.sqrt((w**2).sum()) for x in rows]
    dot = lambda i, j: sum(weights[i][rows[i].index(t)] * weights[j][rows[j].index(t)] for t in rows[i] if t in rows[j])
    want = {(i, j) for i, j in itertools.combinations(range(50), 2) if round(dot(i, j), 9) >= min_dot}
    whole = _blocks_of(rows)
    pairs = lambda found: [(a, b) for i, j in found for a, b in zip(i.tolist(), j.tolist())]
    got = pairs(blocks.near_rows(whole, whole, np.concatenate(weights), np.concatenate(weights), min_dot))
    assert len(got) == len(want) and set(got) == want
    one, two = _blocks_of(rows[:20]), _blocks_of(rows[20:])
    got = pairs(blocks.near_rows(one, two, np.concatenate(weights[:20]), np.concatenate(weights[20:]), min_dot))
    assert {(i, j + 20) for i, j in got} == {(i, j) for i, j in want if i < 20 <= j}


def test_near_vectors_add_up_repeated_terms(spark):
    half = [("a", 1, 0.5)] * 2 + [("b", 2, 0.6)]
    rows = [(1, half), (2, [("a", 1, 0.8), ("b", 2, 0.6)]), (3, [("c", 1, 1.0)])]
    points = spark.createDataFrame(rows, "point long, terms array<struct<term:string,df:long,weight:double>>")
    # 2 * 0.5 * 0.8 + 0.6 * 0.6 = 1.16, but the lengths are sqrt(0.86) and 1
    assert [tuple(r) for r in clustering.near_vectors(points, 0.92).collect()] == [(1, 2)]
    assert clustering.near_vectors(points, 0.94).isEmpty()


@pytest.mark.parametrize("linkage", ["average", "complete"])
@pytest.mark.parametrize("whole", [0, 2048])
def test_hierarchical_merges_by_the_distances_of_all_pairs(spark, linkage, whole, monkeypatch):
    # nearly all pairs lie further apart than 0.75, as in texts of real length; by rounds of tables and on a matrix
    monkeypatch.setattr(linkages, "WHOLE", whole)
    monkeypatch.setattr(blocks, "LEAST_ITEMS", 80)
    rng = random.Random(9)
    texts = [" ".join(["all"] + rng.sample([f"w{i}" for i in range(60)], rng.randint(8, 20))) for _ in range(9)]
    texts += texts[:3]
    clusters = {}
    for r in clustering.hierarchical(frame(spark, texts), "text", 3, linkage).collect():
        clusters.setdefault(r["cluster"], set()).add(r["row_idx"])
    assert {frozenset(c) for c in clusters.values()} == flat_clusters(texts, 3, linkage)
    assert len(clusters) == 3 and all(min(c) == name for name, c in clusters.items())


@pytest.mark.parametrize("same", [True, False])
def test_near_rows_equal_products_of_matrices(same, monkeypatch):
    monkeypatch.setattr(blocks, "SKETCHED_ROWS", 7)
    monkeypatch.setattr(blocks, "LOOKED_UP", 20)
    monkeypatch.setattr(blocks, "PLACES", 100)
    rng = np.random.default_rng(3)

    def block(n, of):
        counts = rng.integers(3, 9, n)
        counts[-1] = 0
        items = np.concatenate([np.sort(rng.choice(of, c, replace=False)) for c in counts])
        weights = rng.random(len(items)) + 0.2
        rows = np.repeat(np.arange(n), counts)
        weights /= np.sqrt(np.bincount(rows, weights**2, n))[rows]
        return blocks.Block(None, counts.astype(np.int64), items), weights

    a, w = block(60, np.arange(20))
    b, v = (a, w) if same else block(50, np.arange(5, 40))

    def dense(block, weights):
        out = np.zeros((len(block.counts), 40))
        out[block.rows, block.items] = weights
        return out

    dots = np.floor(dense(a, w) @ dense(b, v).T * 1e9 + 0.5) / 1e9
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(dots >= 0.45)) if not same or i < j}
    found = [(int(i), int(j)) for x, y in blocks.near_rows(a, b, w, v, 0.45) for i, j in zip(x, y)]
    assert set(found) == want and len(found) == len(want) > 20


def test_near_rows_of_many_candidates_search_little(monkeypatch):
    n = 200
    rows = blocks.Block(None, np.full(n, 4, np.int64), np.tile(np.arange(4), n))
    weights = np.full(4 * n, 0.5)
    searched, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda x, y, *rest: searched.append(np.size(y)) or search(x, y, *rest))
    assert sum(len(i) for i, _ in blocks.near_rows(rows, rows, weights, weights, 0.9)) == n * (n - 1) // 2
    assert sum(searched) < 30_000  # 80,000 items of pairs are compared, each once


def test_near_pairs_are_compared_in_tasks(spark):
    # no pair travels with the words of its sets
    found = similarity.near_pairs(frame(spark, texts_of(20, 8)), "text", 0.4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" not in plan and "Join" not in plan.split("FlatMapGroupsInArrow")[0]


def test_blocks_travel_packed():
    lists = [[3, 9, 2_000_000_000], [], [5], [1, 2, 4, 8], []]
    column = pa.array([[0]] + lists, pa.list_(pa.int32())).slice(1)  # a slice, as of a batch
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 5), pa.array(range(5)), column], names=["__block", "row", "ids"])
    (packed,) = blocks._packing("ids")(iter([batch]))
    assert packed["__block"].to_pylist() == [7]
    table = blocks._unpacked(pa.chunked_array([packed["rows"], packed["rows"]]), "ids")
    assert table["ids"].to_pylist() == 2 * lists and table["row"].to_pylist() == 2 * list(range(5))


def test_tree_reads_vectors_it_keeps(spark, monkeypatch):
    # the passes of the fit read stored vectors, without their texts
    seen, fit = [], classify.DecisionTreeClassifier.fit
    monkeypatch.setattr(classify.DecisionTreeClassifier, "fit", lambda self, df: seen.append((df.columns, df.storageLevel.useDisk)) or fit(self, df))
    rows = spark.createDataFrame([(i, ("good day", "bad night")[i % 2], i % 2) for i in range(8)], "row_idx long, text string, target int")
    model = classify.fit_tree(rows, "text")
    assert seen == [(["features", "__label"], True)]
    assert {(r["row_idx"] % 2, r["predicted"]) for r in classify.predict_tree(model, rows, "text").collect()} == {(0, 0), (1, 1)}
