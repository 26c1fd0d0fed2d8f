import random

import pytest

import corpus_pipeline
from textmill.llm.queries import QUERIES

public = pytest.importorskip("public_tokenizers")


def test_each_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secret_scan", "mixing", "encoding"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, toxic = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randint(20, 80))]
        toxic.append(i % 4 == 1)
        if toxic[-1]:
            words[3] = "idiot"
        if i % 7 == 0:
            words[5] = "password=abcdef0123456789"
        rows.append((i, " ".join(words), "en", "ab"[i % 2]))
    rows += [(500 + i, rows[2 * i][1] + " tail", "en", None) for i in range(20)] + [(600, None, None, None), (601, "", "en", "a")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(t)) for i, t in enumerate(toxic)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r for r in rows}, toxic


def test_stages_in_turn(spark, folder):
    path, rows, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, path)
    assert clean.columns == columns
    kept = {r.doc_id for r in clean.collect()}
    gone_wrong = sum(i not in kept for i in rows if not (i < 400 and toxic[i]) and not (500 <= i < 520 and toxic[2 * (i - 500)]))
    assert gone_wrong <= 8 and sum(i in kept for i in range(400) if toxic[i]) <= 8
    single = stages["near_duplicates"](spark, docs, path)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == set(rows) - set(range(500, 520))
    masked = stages["secret_scan"](spark, docs, path)
    assert masked.columns == columns and masked.count() == docs.count()
    assert not masked.filter("text LIKE '%abcdef0123456789%'").count()
    mixed = stages["mixing"](spark, docs, path)
    assert mixed.columns == columns and mixed.count() > 0
    done = stages["encoding"](spark, docs, path)
    assert done.count() == docs.count()


def test_run_and_empty_table(spark, folder):
    path, _, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 100
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).collect() == []
