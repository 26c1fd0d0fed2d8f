import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textmill import CleaningOptions, MissingRule, TextOptions, Validation, clean
from textmill.functions.text import clean_text
from textmill.operators import columns, language, missing, validate
from textmill.operators.dedup import remove_duplicates


def cleaned(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "row_idx long, t string")
    rows = clean_text(df, "t", TextOptions(**options)).orderBy("row_idx").collect()
    return [(r["cleaned"], r["reason"]) for r in rows]


def test_text_chain_reasons(spark):
    texts = [None, "", "RT @user hello", "RTs are fine", "nice 😀 but 😢", "  a   b ", "@only", "#tag and a.b@c.org <b>x</b>", "  "]
    assert cleaned(spark, texts) == [
        ("", "Absent_text"), ("", "Absent_text"), ("", "Retweet"), ("RTs are fine", None),
        ("", "positive_and_negative"), ("a b", None), ("", "empty_after_cleaning"), ("tag and x", None), ("", "empty_after_cleaning"),
    ]


def test_urls_after_punctuation_leave_words_unless_first(spark):
    text = ["see https://example.com/p?id=1 now"]
    assert cleaned(spark, text) == [("see https example com p id 1 now", None)]
    assert cleaned(spark, text, urls_first=True) == [("see now", None)]
    assert cleaned(spark, text, punctuation=False) == [("see  now", None)]


def test_accents_survive_and_language_filter(spark):
    assert cleaned(spark, ["été, à Noël!"]) == [("été à Noël", None)]
    texts = ["the cat is on the mat", "le chat est dans la maison", "zzz"]
    assert [r for _, r in cleaned(spark, texts, only_french=True)] == ["not_french", None, None]
    assert [r for _, r in cleaned(spark, texts, only_english=True)] == [None, "not_english", None]


def test_languages_from_counted_triples(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    held = docs.filter(language.fold("doc_id") == 0)
    model = language.fit_languages(docs.filter(language.fold("doc_id") != 0), "text", "lang")
    judged = language.with_language(held, "text", "detected", model).collect()
    assert len(judged) > 20 and sum(r.lang == r.detected for r in judged) / len(judged) >= 0.95
    # languages are those of the labelled texts, whatever they are
    rows = [("a", "one two three four"), ("b", "x\u00e9\u00e9k q\u00e9\u00e9z \U0001f600\U0001f601"), (None, "zzz")]
    model = language.fit_languages(spark.createDataFrame(rows, "l string, t string"), "t", "l")
    odd = spark.createDataFrame([(0, "FOUR three"), (1, "q\u00e9\u00e9z"), (2, "..."), (3, None), (4, ""), (5, "two " * 50_000)], "i int, t string")
    found = {r.i: r.d for r in language.with_language(odd, "t", "d", model).collect()}
    assert found == {0: "a", 1: "b", 2: None, 3: None, 4: None, 5: "a"}
    french = spark.createDataFrame([("fr", "one two three four"), ("xx", "x\u00e9\u00e9k q\u00e9\u00e9z")], "l string, t string")
    detect = language.by_model(language.fit_languages(french, "t", "l"))
    only = clean_text(odd.withColumnRenamed("i", "row_idx"), "t", TextOptions(only_french=True), detect=detect)
    assert {r.row_idx for r in only.filter("reason = 'not_french'").collect()} == {1}


def test_missing_rules(spark):
    df = spark.createDataFrame([(0, 1.0, "x"), (1, None, "y"), (2, 3.0, "x"), (3, 5.0, None), (4, 7.0, "y")], "row_idx long, a double, b string")
    fill = lambda s, cols, **k: [tuple(r) for r in missing.apply_rules(df, [MissingRule(s, cols, **k)], "row_idx").orderBy("row_idx").select("a", "b").collect()]
    assert fill("fill_mean", ("a", "b"))[1] == (4.0, "y")
    assert fill("fill_median", ("0",))[1] == (4.0, "y")
    assert fill("fill_mode", ("b",))[3] == (5.0, "x")
    assert fill("fill_constant", ("b",), constant="?")[3] == (5.0, "?")
    assert len(fill("drop_rows", ())) == 3


def test_exact_median_narrows(spark):
    even = spark.range(0, 20_000).select((F.col("id") * 3 % 20_000).cast("double").alias("v"))
    assert missing.exact_median(even, "v") == 9999.5
    hot = spark.range(0, 9_001).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") / 2).alias("v"))
    values = sorted(r["v"] for r in hot.collect())
    assert missing.exact_median(hot, "v") == values[4500]
    same = spark.range(0, 5_000).select(F.lit(2.5).alias("v"))
    assert missing.exact_median(same, "v") == 2.5
    both = spark.range(0, 101).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"), F.lit(None).cast("int").alias("c"))
    assert missing.exact_medians(both, ["a", "b", "c"]) == {"a": 50.0, "b": 100.0}


def test_validations(spark):
    rows = [
        (0, "0", "1", "Mon Apr 06 22:19:45 PDT 2009"), (1, "2", "2", "2025-01-01"), (2, "4", "1", "2025-1-2 3:4:5"),
        (3, "1", "", "2025-02-30"), (4, None, None, None), (5, "1.0", "3", "nope"), (6, "04", "4", "Mon Foo 06 22:19:45 PDT 2009"),
    ]
    df = spark.createDataFrame(rows, "row_idx long, polarity string, id string, date string")
    keep = lambda rule: [r[0] for r in validate.validate(df, [rule]).orderBy("row_idx").select("row_idx").collect()]
    assert keep(Validation("polarity", "allowed_values", (0, 2, 4))) == [0, 1, 2, 4, 6]
    assert keep(Validation("polarity", "allowed_values")) == list(range(7))
    assert keep(Validation("id", "unique_id")) == [0, 1, 5, 6]
    assert keep(Validation("date", "date")) == [0, 1, 2]
    assert keep(Validation("id", "not_empty")) == [0, 1, 2, 5, 6]
    assert keep(Validation("id", "max_length", max_length=2)) == [0, 1, 2, 3, 5, 6]


def test_names_need_no_mapping_and_unknown_ones_raise():
    data = ["a", "b"]
    assert columns.resolve(data, "b") == "b"
    assert columns.resolve(data, "0") == "a"
    assert columns.resolve(data, "tweet", {1: "tweet"}) == "b"
    assert columns.resolve(data, "nope", lenient=True) is None
    assert columns.parse_keep("0:target, 5:tweet, x:id, 2:other, 3") == {0: "target", 5: "tweet"}


def test_duplicates_keep_first_and_nulls_are_equal(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", "x")], "row_idx long, p string, q string")
    assert sorted(tuple(r) for r in remove_duplicates(df).collect()) == [(1, "a", None), (2, "b", "x")]


def test_run_counts_add_up(spark):
    rows = [(i, "t" + str(i % 3) if i % 4 else None, "u" if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "row_idx long, tweet string, name string")
    options = CleaningOptions(
        validations=[Validation("name", "not_empty")], remove_duplicates=True, text=TextOptions(columns=["tweet"]),
        missing=[MissingRule("drop_rows")], keep={0: "tweet"},
    )
    result = clean(df, options)
    n = {r["metric"]: r["n"] for r in result.row_metrics.collect()}
    assert n["initial_rows"] == 40 and n["final_rows"] == result.data.count()
    assert n["initial_rows"] - n["final_rows"] == n["rows_removed"]
    removed = ("rows_removed_validation", "duplicate_rows", "rows_removed_empty_text", "rows_dropped_missing")
    assert sum(n[m] for m in removed) == n["rows_removed"]
    assert result.data.columns == ["row_idx", "tweet"]
    reasons = {r["metric"]: r["n"] for r in result.reason_metrics.collect()}
    assert reasons == {"empty_1": 8, "Absent_text": 1}


def test_language_slots_are_counted_in_the_task(spark, monkeypatch):
    # portions of a few characters; a letter beyond the basic plane is one character
    monkeypatch.setattr(language, "CHARACTERS", 8)
    texts = ["the cat", None, "", "!!", "a", "\U00010400b le chat", "x" * 30]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    spaced = [r[0] for r in rows.orderBy("i").select(language.spaced(F.col("t"))).collect()]
    want = [[sum(ord(c) * f for c, f in zip(s[k : k + 3], language.FACTORS)) % language.SLOTS for k in range(len(s) - 2)] for s in spaced]
    got = [[] for _ in texts]
    for which, slots, counts in language._portions(pa.array(spaced)):
        edges = np.cumsum([0, *counts])
        for n, i in enumerate(range(which.start, which.stop)):
            got[i] = slots[edges[n] : edges[n + 1]].tolist()
    assert got == want
    model = language.fit_languages(rows.withColumn("l", F.lit("en")), "t", "l")
    assert "MapInArrow" in model._jdf.queryExecution().executedPlan().toString()
    none = language.fit_languages(rows.withColumn("l", F.lit(None).cast("string")), "t", "l")
    assert {r.d for r in language.with_language(rows, "t", "d", none).collect()} == {None}
