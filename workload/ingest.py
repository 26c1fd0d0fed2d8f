"""Sources, sinks, previews and run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.operators.columns import dataset_profile
from textmill.sources import files
from textmill.sources.records import scan_records
from textmill.sources.runs import choose_artefact, latest_per_key
from textmill.sources.scratch import new_path
from workload.registry import query
from workload.views import load, oracle


@query(
    "csv_headerless_scan",
    "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, doc_id, text, lang FROM documents",
)
def csv_headerless_scan(spark, sf_dir):
    path = new_path(spark, "headerless")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang").orderBy("doc_id")
    files.write_table(docs, path, "csv", header=False)
    rows = scan_records(spark, path, row_idx="row_idx")
    return rows.select("row_idx", F.col("_c0").cast("bigint").alias("doc_id"), F.col("_c1").alias("text"), F.col("_c2").alias("lang"))


@query("csv_header_scan", "SELECT doc_id, text, n_chars FROM documents")
def csv_header_scan(spark, sf_dir):
    path = new_path(spark, "headered")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    files.write_table(docs, path, "csv", header=True)
    return scan_records(spark, path, docs.schema, header=True).drop("file")


# texts that fit one byte per character are written as cp1252 with a euro sign, the others as UTF-8
ONE_BYTE = "^[\\x{{00}}-\\x{{7F}}\\x{{A0}}-\\x{{FF}}]*$"


@query(
    "encoding_normalise",
    f"""SELECT doc_id, lang, CASE WHEN regexp_matches(text, '{ONE_BYTE.format()}') THEN text || ' €' ELSE text END AS text
        FROM documents""",
)
def encoding_normalise(spark, sf_dir):
    path = new_path(spark, "charsets")
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), "lang", "text")
    narrow = F.col("text").rlike(ONE_BYTE.format())
    euro = F.concat("text", F.lit(" \x80"))
    options = {"quote": '"', "escape": '"', "ignoreTrailingWhiteSpace": "false", "ignoreLeadingWhiteSpace": "false"}
    docs.filter(narrow).withColumn("text", euro).write.options(**options, encoding="ISO-8859-1").csv(f"{path}/part=1")
    docs.filter(~narrow).write.options(**options).csv(f"{path}/part=2")
    rows = files.normalise_csv(spark, path, ["doc_id", "lang", "text"])
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text")


@query(
    "delimiter_choice",
    """SELECT 'bars' AS variant, '|' AS sep, doc_id, source FROM documents
       UNION ALL SELECT 'commas', ',', doc_id, source FROM documents""",
)
def delimiter_choice(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    read = []
    for variant, sep in (("commas", ","), ("bars", "|")):
        path = new_path(spark, variant)
        docs.write.option("sep", sep).csv(path)
        found = files.choose_delimiter(spark, path)
        rows = files.read_csv(spark, path, sep=found)
        read.append(
            rows.select(
                F.lit(variant).alias("variant"), F.lit(found).alias("sep"),
                F.col("_c0").cast("bigint").alias("doc_id"), F.col("_c2").alias("source"),
            )
        )
    return read[0].unionByName(read[1])


@query("sink_roundtrip", oracle("tweets", "", "SELECT doc_id, target, tweet FROM tweets"))
def sink_roundtrip(spark, sf_dir):
    tweets = load(spark, sf_dir, "tweets")
    stored, edge = new_path(spark, "stage"), new_path(spark, "export")
    files.write_table(tweets, stored)
    files.write_table(spark.read.parquet(stored), edge, "csv", header=True)
    return files.read_csv(spark, edge, header=True, schema=tweets.schema, multi_line=True)


@query("preview_topn", oracle("raw_tweets", "", "SELECT * FROM raw_tweets ORDER BY row_idx LIMIT 5"))
def preview_topn(spark, sf_dir):
    return files.preview(load(spark, sf_dir, "raw_tweets"), 5)


@query(
    "dataset_profile",
    oracle(
        "raw_tweets",
        """head AS (SELECT * FROM raw_tweets ORDER BY row_idx LIMIT 10),
           lengths AS (
             SELECT 0 AS i, 'polarity' AS c, avg(length(coalesce(polarity, ''))) AS n FROM head UNION ALL
             SELECT 1, 'id', avg(length(coalesce(id, ''))) FROM head UNION ALL
             SELECT 2, 'date', avg(length(coalesce(date, ''))) FROM head UNION ALL
             SELECT 3, 'username', avg(length(username)) FROM head UNION ALL
             SELECT 4, 'tweet', avg(length(coalesce(tweet, ''))) FROM head)""",
        """SELECT (SELECT count(*) FROM raw_tweets) AS total_count, i AS text_column_index, c AS text_column
           FROM lengths WHERE n > 10 ORDER BY n DESC, i LIMIT 1""",
    ),
)
def profile(spark, sf_dir):
    return dataset_profile(load(spark, sf_dir, "raw_tweets"))


@query(
    "artefact_choice",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'labeled/' || d.doc_id
                          WHEN lang IN ('en', 'fr') THEN 'cleaned/' || d.doc_id ELSE 'raw/' || d.doc_id END AS train_file,
              CASE WHEN lang IN ('en', 'fr') THEN 'cleaned/' || d.doc_id ELSE 'raw/' || d.doc_id END AS predict_file
       FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def artefact_choice(spark, sf_dir):
    name = lambda folder: F.concat(F.lit(f"{folder}/"), F.col("doc_id").cast("string"))
    labelled = load(spark, sf_dir, "labels").select("doc_id", name("labeled").alias("labeled_file"))
    runs = (
        load(spark, sf_dir, "documents")
        .select(
            "doc_id", name("raw").alias("original_file"),
            F.when(F.col("lang").isin("en", "fr"), name("cleaned")).otherwise("").alias("cleaned_file"),
        )
        .join(labelled, "doc_id", "left")
    )
    return runs.select("doc_id", choose_artefact("train").alias("train_file"), choose_artefact("predict").alias("predict_file"))


LATEST = "QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, model_id DESC) = 1"


@query("latest_run_per_key", oracle("runs", "", f"SELECT * FROM runs {LATEST}"))
def latest_run_per_key(spark, sf_dir):
    return latest_per_key(load(spark, sf_dir, "runs"), ["session_id"], ["created_at", "model_id"])


@query(
    "keyword_list_load",
    """SELECT DISTINCT lower(trim(w)) AS word FROM
         (SELECT unnest(string_split(' ' || upper(p_name) || ' , ' || p_brand || ',,', ',')) AS w FROM part)
       WHERE trim(w) <> ''""",
)
def keyword_list_load(spark, sf_dir):
    path = new_path(spark, "keywords")
    line = F.concat(F.lit(" "), F.upper("p_name"), F.lit(" , "), "p_brand", F.lit(",,"))
    load(spark, sf_dir, "part").select(line).write.text(path)
    return files.keyword_list(spark, path)
