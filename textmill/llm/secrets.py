"""Secret scans over an incremental ledger of blobs, with DataFrame functions only.

Every version of a text is addressed by the SHA-256 of its content. The ledger holds one row for each
(blob, rule version) that was ever scanned; a run scans only the blobs that lack one, appends them, and
joins the findings back to all versions. Each task sends a text once, whatever its copies, and each blob is
scanned once; versions only send their address.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm.common import table
from textmill.llm.registry import query
from textmill.sources.scratch import new_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``at_least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1


# Fixed values. Where a run of one character class has to reach a length, the length stands in the
# pattern: the leftmost greedy match takes the whole run either way.
BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
# ``after``: where the spans before this one end, so that overlapping ones can be told without a look back
SPAN = "struct<start:int,kind:int,end:int,after:int>"


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans) of ``blobs(blob, text)``, one row a blob: spans ordered by start, then rule; code points, end exclusive.

    The pieces between the matches and the matches alternate, so running sums of their lengths are the
    positions. The sums are windows over the matches of one blob and rule.
    """
    found = [
        F.when(
            F.regexp_like("text", F.lit(r.pattern)),
            F.struct(
                F.lit(k).alias("kind"),
                F.transform(F.split("text", r.pattern, -1), F.length).alias("gaps"),
                F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)), F.length).alias("sizes"),
                F.transform(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)), F.length).alias("values"),
            ),
        )
        for k, r in enumerate(rules)
    ]
    per_rule = (
        blobs.select("blob", F.array(*found).alias("found"))
        .select("blob", F.explode("found").alias("f"))
        .filter(F.col("f").isNotNull())
    )
    matches = per_rule.select(
        "blob", F.col("f.kind").alias("kind"), F.posexplode(F.arrays_zip("f.gaps", "f.sizes", "f.values"))
    ).select("blob", "kind", "pos", "col.gaps", "col.sizes", "col.values")
    so_far = Window.partitionBy("blob", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    needed = F.element_at(F.array(*[F.lit(r.at_least) for r in rules]), F.col("kind") + 1)
    placed = (
        matches.filter("sizes IS NOT NULL")
        .withColumn("end", F.sum(F.col("gaps") + F.col("sizes")).over(so_far).cast("int"))
        .filter(F.col("values") >= needed)
        .withColumn("start", F.col("end") - F.col("sizes"))
    )
    earlier = Window.partitionBy("blob").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("after", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    placed = placed.withColumn("span", F.struct("start", "kind", "end", "after").cast(SPAN))
    return placed.groupBy("blob").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(blob, rules, spans) of all scans so far, one row for each (blob, rules); an absent ledger is an empty one.

    Runs at the same time may each append the same blob; the spans are the same, and one row stays.
    """
    schema = f"blob string, rules string, spans array<{SPAN}>"
    try:
        return spark.read.schema(schema).parquet(path).groupBy("blob", "rules").agg(F.max("spans").alias("spans"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # from no Python rows, whose workers would stay beside those of other tasks
        return spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("row")).select("row.*")


def scan(versions: DataFrame, text: str, ledger: str, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """All rows of ``versions`` with a last column ``spans``; new blobs are added to the ``ledger`` folder.

    A row is a version of a file, at whatever path; all columns, so the paths too, pass through. A null text is an empty
    one, and neither holds spans. Repeated rows stay, each with its spans. A column ``spans`` of the input is
    replaced. An empty table gives an empty result.
    """
    spark = versions.sparkSession
    version = rule_version(rules)
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = versions.select(F.struct(*[f"`{c}`" for c in versions.columns if c != "spans"]).alias("row"), F.sha2(content, 256).alias("blob"))
    known = read_ledger(spark, ledger).filter(F.col("rules") == version).select("blob")
    unseen = rows.select("blob").distinct().join(known, "blob", "left_anti")
    # equal texts are put together where they are read, so that one row of each blob is scanned
    texts = versions.select(F.sha2(content, 256).alias("blob"), content.alias("text"))
    fresh = texts.groupBy("blob").agg(F.first("text").alias("text")).join(known, "blob", "left_anti")
    scanned = unseen.join(find_spans(fresh, rules), "blob", "left")
    scanned.select("blob", F.lit(version).alias("rules"), "spans").write.mode("append").parquet(ledger)
    # a hot blob is on the large side of this join only, whose partitions Spark splits
    found = read_ledger(spark, ledger).filter((F.col("rules") == version) & F.col("spans").isNotNull())
    none = F.array().cast(f"array<{SPAN}>")
    return rows.join(found.select("blob", "spans"), "blob", "left").select(
        "row.*", F.coalesce("spans", none).alias("spans")
    )


def redact(scanned: DataFrame, text: str, mask: str = "[secret]") -> DataFrame:
    """``scanned`` without ``spans``, each text with its found values replaced by ``mask``.

    Overlapping spans of several rules are replaced once. Texts without spans stay as they are.
    """
    own = F.col(f"`{text}`")
    # what stands before each span that starts past all earlier ones, and the mask; then the rest
    piece = lambda p: F.when(p["start"] >= p["after"], F.concat(F.substring(own, p["after"] + 1, p["start"] - p["after"]), F.lit(mask)))
    reach = F.array_max(F.transform("spans", lambda p: p["end"]))
    kept = F.concat(F.array_join(F.transform("spans", piece), ""), F.substring(own, reach + 1, F.length(own)))
    clean = F.when(F.size("spans") > 0, kept).otherwise(own)
    return scanned.select(*[clean.alias(c) if c == text else f"`{c}`" for c in scanned.columns if c != "spans"])


def _joined(spans, rules):
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k].kind}")
    return scanned.select(
        "doc_id", *[count(k) for k in range(len(BASE))],
        F.sha2(_joined(base, rules), 256).alias("base_sha256"), _joined(F.col("spans"), rules).alias("spans"),
    )


def _sql() -> str:
    """The same in SQL: pieces and matches alternate, list sums give the positions."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for k, r in enumerate(BASE + ADDED):
        parts.append(f"""
          SELECT doc_id, {k} AS k, '{r.kind}' AS kind, i,
            CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(hits[1:i], lambda x: length(x))) AS BIGINT) AS e,
            length(hits[i]) AS n, length(vals[i]) AS v
          FROM (SELECT doc_id, string_split_regex(text, {quoted(r.pattern)}) AS gaps,
                  regexp_extract_all(text, {quoted(r.pattern)}) AS hits,
                  regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) AS vals
                FROM documents WHERE regexp_matches(text, {quoted(r.pattern)})) AS t{k}, unnest(range(1, len(hits) + 1)) AS u{k}(i)
          WHERE length(vals[i]) >= {r.at_least}""")
    return f"""
        WITH hits AS ({' UNION ALL '.join(parts)}),
        spans AS (SELECT doc_id, k, kind, e - n AS s, e, kind || ':' || (e - n) || ':' || e AS t FROM hits),
        docs AS (SELECT doc_id,
            count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
            string_agg(t, ',' ORDER BY s, k) FILTER (WHERE k < {len(BASE)}) AS base, string_agg(t, ',' ORDER BY s, k) AS spans
          FROM spans GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
          sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM documents d LEFT JOIN docs USING (doc_id)"""


@query("op9_secret_scan", _sql())
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(scan(docs, "text", new_path(spark, "ledger")))
