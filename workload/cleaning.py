"""Column rules, duplicates, missing values, text steps and the whole cleaning run."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import text as steps
from textmill.functions.language import PROFILES, detect_language
from textmill.operators import columns, language, missing, validate
from textmill.operators.dedup import remove_duplicates
from textmill.options import CleaningOptions, MissingRule, TextOptions, Validation
from textmill.plans.cleaning import clean, drop_empty_text
from workload import sqltext as q
from workload.registry import query
from workload.views import load, oracle

LIMIT = 12
LABELS = (0, 2, 4)

# --- columns ----------------------------------------------------------------------------------


@query("keep_columns", oracle("raw_tweets", "", "SELECT row_idx, polarity AS target, tweet FROM raw_tweets"))
def keep_columns(spark, sf_dir):
    mapping = columns.parse_keep("4:tweet, 0:target, 9:topic, x:id, 3:unknown")
    return columns.keep_columns(load(spark, sf_dir, "raw_tweets"), mapping, "row_idx")


LENGTHS = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", avg(length(coalesce({c}, 'nan'))) AS n FROM raw_tweets"
    for i, c in enumerate(("polarity", "id", "date", "username", "tweet"))
)


@query(
    "detect_text_column",
    oracle(
        "raw_tweets", f"lengths AS ({LENGTHS})",
        'SELECT position, "column" FROM lengths WHERE n > 10 ORDER BY n DESC, position LIMIT 1',
    ),
)
def detect_text_column(spark, sf_dir):
    return columns.detect_text_column(load(spark, sf_dir, "raw_tweets"), "longest", "row_idx")


@query(
    "detect_text_column_by_name",
    oracle(
        "raw_tweets", f"lengths AS ({LENGTHS})",
        """SELECT 'name' AS strategy, 4 AS position, 'tweet' AS "column" FROM lengths WHERE position = 4
           UNION ALL (SELECT 'name_long', position, "column" FROM lengths WHERE n > 20 ORDER BY position LIMIT 1)
           UNION ALL (SELECT 'first', position, "column" FROM lengths WHERE n > 10 AND position > 0 ORDER BY position LIMIT 1)""",
    ),
)
def detect_text_column_by_name(spark, sf_dir):
    raw = load(spark, sf_dir, "raw_tweets")
    renamed = raw.withColumnRenamed("tweet", "body")
    found = [
        columns.detect_text_column(raw, "name", "row_idx").select(F.lit("name").alias("strategy"), "*"),
        columns.detect_text_column(renamed, "name_long", "row_idx").select(F.lit("name_long").alias("strategy"), "*"),
        columns.detect_text_column(raw, "first", "row_idx").select(F.lit("first").alias("strategy"), "*"),
    ]
    united = found[0].unionByName(found[1]).unionByName(found[2])
    return united.withColumn("column", F.when(F.col("column") == "body", "tweet").otherwise(F.col("column")))


@query(
    "detect_text_column_sample",
    oracle(
        "raw_tweets",
        f"""head AS (SELECT * FROM raw_tweets ORDER BY row_idx LIMIT 10),
            lengths AS ({LENGTHS.replace("'nan'", "''").replace("FROM raw_tweets", "FROM head")})""",
        'SELECT position, "column" FROM lengths WHERE n > 10 ORDER BY n DESC, position LIMIT 1',
    ),
)
def detect_text_column_sample(spark, sf_dir):
    return columns.detect_text_column(load(spark, sf_dir, "raw_tweets"), "sample", "row_idx")


@query(
    "detect_target_column",
    oracle("raw_tweets", "", "SELECT row_idx, TRY_CAST(polarity AS INTEGER) AS target FROM raw_tweets"),
)
def detect_target_column(spark, sf_dir):
    raw = load(spark, sf_dir, "raw_tweets")
    name = columns.detect_target_column(raw.columns)
    return raw.select("row_idx", F.col(name).try_cast("int").alias("target"))


@query(
    "truncate_text",
    "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS shown FROM documents",
)
def truncate_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", steps.truncate(F.col("text")).alias("shown"))


# --- validation -------------------------------------------------------------------------------

ALLOWED_SQL = "(polarity IS NULL OR coalesce(regexp_matches(polarity, '^[0-9]+$') AND TRY_CAST(polarity AS BIGINT) IN (0, 2, 4), false))"
UNIQUE_SQL = "(id IS NOT NULL AND id <> '' AND row_idx = min(row_idx) OVER (PARTITION BY id))"
DATE_SQL = """(try_strptime(date, ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S']) IS NOT NULL
    OR coalesce(try_strptime(regexp_replace(date, '^[A-Za-z]{3} (\\w+ \\d+ [0-9:]+) \\S+ (\\d{4})$', '\\1 \\2'), '%b %d %H:%M:%S %Y') IS NOT NULL, false))"""
EMPTY_SQL = f"(tweet IS NOT NULL AND {q.strip('tweet')} <> '')"
LENGTH_SQL = f"(length(coalesce(username, 'nan')) <= {LIMIT})"
RULES = {
    "validate_allowed_values": (Validation("polarity", "allowed_values", LABELS), ALLOWED_SQL),
    "validate_unique_id": (Validation("id", "unique_id"), UNIQUE_SQL),
    "validate_date": (Validation("date", "date"), DATE_SQL),
    "validate_not_empty": (Validation("tweet", "not_empty"), EMPTY_SQL),
    "validate_max_length": (Validation("username", "max_length", max_length=LIMIT), LENGTH_SQL),
}
ALL_FLAGS = "flags AS (SELECT *, " + ", ".join(f"{sql} AS r{i}" for i, (_, sql) in enumerate(RULES.values())) + " FROM raw_tweets)"


def _register_rule(name, rule, sql):
    @query(name, oracle("raw_tweets", "", f"SELECT row_idx FROM (SELECT row_idx, {sql} AS ok FROM raw_tweets) WHERE ok"))
    def run(spark, sf_dir):
        return validate.validate(load(spark, sf_dir, "raw_tweets"), [rule]).select("row_idx")


for _name, (_rule, _sql) in RULES.items():
    _register_rule(_name, _rule, _sql)


@query(
    "validate_combined",
    oracle("raw_tweets", ALL_FLAGS, "SELECT row_idx, polarity, id, date, username, tweet FROM flags WHERE r0 AND r1 AND r2 AND r3 AND r4"),
)
def validate_combined(spark, sf_dir):
    return validate.validate(load(spark, sf_dir, "raw_tweets"), [rule for rule, _ in RULES.values()])


FAILURES_SQL = """
    SELECT 'invalid_polarity_0' AS metric, count(*) AS n FROM flags WHERE NOT r0
    UNION ALL SELECT 'repeated_ids_1', count(*) FROM flags WHERE NOT r1 AND id IS NOT NULL AND id <> ''
    UNION ALL SELECT 'wrong_date_format_2', count(*) FROM flags WHERE NOT r2 AND date IS NOT NULL
    UNION ALL SELECT 'empty_4', count(*) FROM flags WHERE NOT r3
    UNION ALL SELECT 'too_long_3', count(*) FROM flags WHERE NOT r4 AND username IS NOT NULL"""


@query("validation_counts", oracle("raw_tweets", ALL_FLAGS, FAILURES_SQL))
def validation_counts(spark, sf_dir):
    flagged, _, failures = validate.flag_rows(load(spark, sf_dir, "raw_tweets"), [rule for rule, _ in RULES.values()])
    return validate.count_failures(flagged, failures)


# --- duplicates and missing values ------------------------------------------------------------


@query("remove_duplicates", "SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang")
def duplicates(spark, sf_dir):
    return remove_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")


KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("missing_drop_rows", oracle("line_missing", "", "SELECT * FROM line_missing WHERE qty IS NOT NULL AND flag IS NOT NULL"))
def missing_drop_rows(spark, sf_dir):
    return missing.apply_rules(load(spark, sf_dir, "line_missing"), [MissingRule("drop_rows")])


@query(
    "missing_fill_constant",
    oracle("line_missing", "", f"SELECT {KEYS}, coalesce(qty, 7.0) AS qty, coalesce(flag, '7') AS flag FROM line_missing"),
)
def missing_fill_constant(spark, sf_dir):
    return missing.apply_rules(load(spark, sf_dir, "line_missing"), [MissingRule("fill_constant", ("qty", "flag"), "7")])


@query(
    "missing_fill_mean",
    oracle("line_missing", "", f"SELECT {KEYS}, round(coalesce(qty, (SELECT avg(qty) FROM line_missing)), 6) AS qty, flag FROM line_missing"),
)
def missing_fill_mean(spark, sf_dir):
    filled = missing.apply_rules(load(spark, sf_dir, "line_missing"), [MissingRule("fill_mean", ("qty", "flag"))])
    return filled.withColumn("qty", F.round("qty", 6))


@query(
    "missing_fill_median",
    oracle("line_missing", "", f"SELECT {KEYS}, coalesce(qty, (SELECT median(qty) FROM line_missing)) AS qty, flag FROM line_missing"),
)
def missing_fill_median(spark, sf_dir):
    return missing.apply_rules(load(spark, sf_dir, "line_missing"), [MissingRule("fill_median", ("qty", "flag"))])


MODE_SQL = "(SELECT {0} FROM line_missing WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1)"


@query(
    "missing_fill_mode",
    oracle(
        "line_missing", "",
        f"SELECT {KEYS}, coalesce(qty, {MODE_SQL.format('qty')}) AS qty, coalesce(flag, {MODE_SQL.format('flag')}) AS flag FROM line_missing",
    ),
)
def missing_fill_mode(spark, sf_dir):
    return missing.apply_rules(load(spark, sf_dir, "line_missing"), [MissingRule("fill_mode", ("qty", "flag"))])


@query(
    "missing_rules_sequence",
    oracle(
        "line_missing",
        "step1 AS (SELECT * FROM line_missing WHERE flag IS NOT NULL)",
        f"SELECT {KEYS}, coalesce(qty, (SELECT median(qty) FROM step1)) AS qty, flag FROM step1",
    ),
)
def missing_rules_sequence(spark, sf_dir):
    rules = [MissingRule("drop_rows", (5,)), MissingRule("fill_median", ("4",)), MissingRule("fill_mode")]
    return missing.apply_rules(load(spark, sf_dir, "line_missing"), rules)


# --- text steps -------------------------------------------------------------------------------


def _register_step(name, table, key, column, step, sql):
    @query(name, oracle("tweets", "", f"SELECT {key}, {sql} AS out FROM {table}"))
    def run(spark, sf_dir):
        return load(spark, sf_dir, table).select(key, step(F.col(column)).alias("out"))


_register_step("text_strip_hashtags", "tweets", "doc_id", "tweet", steps.strip_hashtags, "replace(tweet, '#', '')")
_register_step("text_strip_mentions", "tweets", "doc_id", "tweet", steps.strip_mentions, q.no_mentions("tweet"))
_register_step("text_strip_html", "pages", "page_id", "html", steps.strip_html, q.no_html("html"))
_register_step("text_strip_punct", "tweets", "doc_id", "tweet", steps.strip_punctuation, q.no_punct("tweet"))
_register_step("text_collapse_spaces", "pages", "page_id", "html", steps.collapse_spaces, q.one_space("html"))
_register_step("text_strip_urls", "pages", "page_id", "html", steps.strip_urls, q.no_urls("html"))


@query(
    "text_drop_retweets",
    oracle("tweets", "", "SELECT doc_id, tweet FROM tweets WHERE NOT (starts_with(tweet, 'RT ') OR starts_with(tweet, 'RT@'))"),
)
def text_drop_retweets(spark, sf_dir):
    return load(spark, sf_dir, "tweets").filter(~steps.is_retweet(F.col("tweet"))).select("doc_id", "tweet")


@query(
    "text_drop_contradictory",
    oracle("tweets", "", f"SELECT doc_id, tweet FROM tweets WHERE NOT ({q.contradictory('tweet')})"),
)
def text_drop_contradictory(spark, sf_dir):
    return load(spark, sf_dir, "tweets").filter(~steps.is_contradictory(F.col("tweet"))).select("doc_id", "tweet")


@query(
    "drop_empty_text_rows",
    oracle("raw_tweets", "", f"SELECT row_idx FROM raw_tweets WHERE {q.strip('''coalesce(tweet, '')''')} <> '' OR {q.strip('''coalesce(id, '')''')} <> ''"),
)
def drop_empty_text_rows(spark, sf_dir):
    return drop_empty_text(load(spark, sf_dir, "raw_tweets"), ["tweet", "id"]).select("row_idx")


HITS = ", ".join(f"{q.lang_hits('text', p)} AS {code}" for code, p in PROFILES.items())


@query(
    "language_filter",
    oracle(
        "",
        f"""hits AS (SELECT doc_id, lang, {HITS} FROM documents),
            guess AS (SELECT doc_id, lang, CASE WHEN greatest(en, fr, de, es) = 0 THEN NULL
              WHEN en >= greatest(fr, de, es) THEN 'en' WHEN fr >= greatest(de, es) THEN 'fr'
              WHEN de >= es THEN 'de' ELSE 'es' END AS detected FROM hits)""",
        "SELECT doc_id, lang, detected, coalesce(detected = 'fr', true) AS keep_french, coalesce(detected = 'en', true) AS keep_english FROM guess",
    ),
)
def language_filter(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", detect_language(F.col("text")).alias("detected"))
    keep = lambda code: F.coalesce(F.col("detected") == code, F.lit(True))
    return docs.withColumns({"keep_french": keep("fr"), "keep_english": keep("en")})


A, B, C = language.FACTORS
TRIPLES = rf"""
    prepared AS (SELECT doc_id, lang, string_split(' ' || trim(regexp_replace(lower(text), '[^{steps.WORD}]+', ' ', 'g')) || ' ', '') AS c,
        CAST('0x' || substr(md5('42:' || doc_id), 1, 6) AS INT) % {language.HELD_OUT} = 0 AS held_out FROM documents),
    triples AS (SELECT doc_id, lang, held_out,
        (unicode(c[i]) * {A} + unicode(c[i + 1]) * {B} + unicode(c[i + 2]) * {C}) % {language.SLOTS} AS slot
      FROM prepared, unnest(range(1, len(c) - 1)) AS u(i)),
    counted AS (SELECT lang AS l, slot, count(*) AS n FROM triples WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, slot),
    totals AS (SELECT l, sum(n) AS total FROM counted GROUP BY l),
    sums AS (SELECT doc_id, t.l, round(sum(ln((coalesce(n, 0) + 1) / (total + {language.SLOTS}))), 6) AS score
      FROM triples AS x CROSS JOIN totals AS t LEFT JOIN counted AS k ON k.l = t.l AND k.slot = x.slot GROUP BY doc_id, t.l),
    best AS (SELECT doc_id, arg_max(l, [score, -ord]) AS detected FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l) AS ord FROM sums) GROUP BY doc_id)"""


@query(
    "language_model",
    oracle("", TRIPLES, "SELECT p.doc_id, p.lang, p.held_out, b.detected, coalesce(b.detected = 'fr', true) AS keep_french FROM prepared AS p LEFT JOIN best AS b USING (doc_id)"),
)
def language_model(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "text", (language.fold("doc_id") == 0).alias("held_out"))
    model = language.fit_languages(docs.filter("NOT held_out"), "text", "lang")
    found = language.with_language(docs, "text", "detected", model).drop("text")
    return found.withColumn("keep_french", F.coalesce(F.col("detected") == "fr", F.lit(True)))


@query("text_clean_chain", oracle("tweets", q.chain("tweets", "doc_id", "tweet"), "SELECT doc_id, text AS cleaned, reason FROM cleaned"))
def text_clean_chain(spark, sf_dir):
    tweets = load(spark, sf_dir, "tweets").select("doc_id", "tweet")
    return steps.clean_text(tweets, "tweet", TextOptions()).drop("tweet")


# --- the whole run ----------------------------------------------------------------------------

OPTIONS = CleaningOptions(
    validations=(
        Validation("polarity", "allowed_values", LABELS),
        Validation("username", "max_length", max_length=LIMIT),
        Validation("id", "unique_id"),
    ),
    remove_duplicates=True,
    text=TextOptions(columns=("tweet",)),
    missing=(MissingRule("fill_constant", ("target",), "2"), MissingRule("drop_rows", ("date",))),
    keep={0: "target", 1: "id", 4: "tweet"},
)
RUN_CTES = f"""
  flags AS (SELECT *, {ALLOWED_SQL} AS r0, {LENGTH_SQL} AS r1, {UNIQUE_SQL} AS r2 FROM raw_tweets),
  valid AS (SELECT * FROM flags WHERE r0 AND r1 AND r2),
  uniq AS (SELECT polarity, id, date, username, tweet, min(row_idx) AS row_idx FROM valid GROUP BY ALL),
  {q.chain("uniq", "row_idx", "tweet")},
  textual AS (SELECT u.*, c.text FROM uniq u JOIN cleaned c USING (row_idx) WHERE c.text <> ''),
  final AS (SELECT row_idx, coalesce(polarity, '2') AS target, id, text AS tweet FROM textual WHERE date IS NOT NULL),
  sizes AS (SELECT (SELECT count(*) FROM raw_tweets) AS a, (SELECT count(*) FROM valid) AS b, (SELECT count(*) FROM uniq) AS c,
    (SELECT count(*) FROM textual) AS d, (SELECT count(*) FROM final) AS e)"""


@query("cleaning_run", oracle("raw_tweets", RUN_CTES, "SELECT row_idx, target, id, tweet FROM final"))
def cleaning_run(spark, sf_dir):
    return clean(load(spark, sf_dir, "raw_tweets"), OPTIONS).data


ROW_METRICS_SQL = """
  SELECT 'initial_rows' AS metric, a AS n FROM sizes UNION ALL SELECT 'rows_removed_validation', a - b FROM sizes
  UNION ALL SELECT 'duplicate_rows', b - c FROM sizes UNION ALL SELECT 'rows_removed_empty_text', c - d FROM sizes
  UNION ALL SELECT 'rows_dropped_missing', d - e FROM sizes UNION ALL SELECT 'final_rows', e FROM sizes
  UNION ALL SELECT 'rows_removed', a - e FROM sizes"""


@query("cleaning_row_metrics", oracle("raw_tweets", RUN_CTES, ROW_METRICS_SQL))
def cleaning_row_metrics(spark, sf_dir):
    return clean(load(spark, sf_dir, "raw_tweets"), OPTIONS).row_metrics


@query(
    "cleaning_reason_metrics",
    oracle(
        "raw_tweets", RUN_CTES,
        """SELECT * FROM (
             SELECT 'invalid_polarity_0' AS metric, count(*) AS n FROM flags WHERE NOT r0
             UNION ALL SELECT 'too_long_3', count(*) FROM flags WHERE NOT r1 AND username IS NOT NULL
             UNION ALL SELECT 'repeated_ids_1', count(*) FROM flags WHERE NOT r2 AND id IS NOT NULL AND id <> ''
             UNION ALL SELECT reason, count(*) FROM cleaned WHERE reason IS NOT NULL GROUP BY reason) WHERE n > 0""",
    ),
)
def cleaning_reason_metrics(spark, sf_dir):
    return clean(load(spark, sf_dir, "raw_tweets"), OPTIONS).reason_metrics


@query(
    "cleaning_run_documents",
    oracle(
        "",
        f"uniq AS (SELECT min(doc_id) AS row_idx, text AS body, lang, source FROM documents GROUP BY text, lang, source), {q.chain('uniq', 'row_idx', 'body')}",
        "SELECT row_idx, c.text, lang FROM uniq JOIN cleaned c USING (row_idx) WHERE c.text <> ''",
    ),
)
def cleaning_run_documents(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), "text", "lang", "source")
    options = CleaningOptions(remove_duplicates=True, text=TextOptions(columns=("text",)), keep={0: "text", 1: "lang"})
    return clean(docs, options).data
