"""Input views over the given tables: one SQL text per view, read by Spark and by the SQL check.

The views put in the cases the raw tables lack (markers, links, missing and malformed values).
They keep every row and every text as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


VIEWS = {
    "tweets": """
        SELECT d.doc_id AS doc_id,
          CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 4 ELSE 2 END AS target,
          CASE CAST(d.doc_id % 8 AS INT)
            WHEN 0 THEN concat('RT @user', CAST(d.doc_id AS STRING), ' ', d.text)
            WHEN 1 THEN concat(d.text, ' #tag', CAST(d.doc_id % 5 AS STRING))
            WHEN 2 THEN concat('@u', CAST(d.doc_id AS STRING), ' a.b@example.com ', d.text)
            WHEN 3 THEN concat(d.text, ' https://example.com/p?id=', CAST(d.doc_id AS STRING))
            WHEN 4 THEN concat('<b>', d.text, '</b>   :)')
            WHEN 5 THEN concat(d.text, ' 😀 but 😢')
            WHEN 6 THEN NULL
            ELSE d.text END AS tweet
        FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "raw_tweets": """
        SELECT doc_id AS row_idx,
          CASE WHEN doc_id % 11 = 0 THEN '9' WHEN doc_id % 13 = 0 THEN 'x' WHEN doc_id % 17 = 0 THEN NULL
               ELSE CAST(coalesce(target, 2) AS STRING) END AS polarity,
          CASE WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 23 = 0 THEN NULL
               ELSE CAST(doc_id % 700 AS STRING) END AS id,
          CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'Mon Apr 06 22:19:45 PDT 2009' WHEN 1 THEN '2025-01-01'
               WHEN 2 THEN '2025-01-01 10:30:00' WHEN 3 THEN 'invalid date' ELSE NULL END AS date,
          concat('user', CAST(doc_id * doc_id AS STRING)) AS username,
          tweet
        FROM {tweets}""",
    "labelled": """
        SELECT d.doc_id AS row_idx, d.text AS text,
          CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 4 ELSE 2 END AS target
        FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id""",
    "line_missing": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
          CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS qty,
          CASE WHEN l_linenumber = 5 THEN NULL ELSE l_returnflag END AS flag
        FROM {lineitem}""",
    "annotations": """
        SELECT doc_id * 2 AS seq, doc_id AS row_idx, CASE WHEN toxic = 1 THEN 0 ELSE 2 END AS label FROM {labels}
        UNION ALL
        SELECT doc_id * 2 + 1 AS seq, doc_id AS row_idx, 4 AS label FROM {labels} WHERE quality = 1
        UNION ALL
        SELECT -1 AS seq, -1 - doc_id AS row_idx, 4 AS label FROM {labels}""",
    "clustered": """
        SELECT row_idx, target, CAST(length(text) % 6 AS INT) - 1 AS cluster FROM {labelled}""",
    "turns": """
        SELECT conv_id * 1000000 + turn AS row_idx, conv_id, turn, role, text FROM {conversations}""",
    "runs": """
        SELECT user_id AS session_id, event_id AS model_id, ts AS created_at, event_type AS algorithm,
          value AS accuracy FROM {events}""",
}
NEEDS = {
    "tweets": ("documents", "labels"),
    "raw_tweets": ("tweets",),
    "labelled": ("documents", "labels"),
    "line_missing": ("lineitem",),
    "annotations": ("labels",),
    "clustered": ("labelled",),
    "turns": ("conversations",),
    "runs": ("events",),
}

POSITIVES = ["with", "this", "from", "for"]
NEGATIVES = ["was", "but", "that", "der"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view over the given tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{n: load(spark, sf_dir, n) for n in NEEDS[name]})


def _collect(name: str, found: dict[str, str]) -> None:
    if name in VIEWS and name not in found:
        for need in NEEDS[name]:
            _collect(need, found)
        found[name] = VIEWS[name].format(**{n: n for n in NEEDS[name]})


def oracle(views: str, ctes: str, select: str) -> str:
    """WITH the named views and the given expressions, then the select."""
    found: dict[str, str] = {}
    for name in views.split():
        _collect(name, found)
    parts = [f"{name} AS ({sql})" for name, sql in found.items()]
    if ctes.strip():
        parts.append(ctes.strip().rstrip(","))
    return (f"WITH RECURSIVE {', '.join(parts)}\n" if parts else "") + select
