"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join, with DataFrame functions only.

Two kinds of entries judge a url. A listed URL stands for all urls of the same canonical form and is blocked.
A rule (host, path) fits its host and all subdomains of it where the url's path starts with the rule's, and says
allow or block; the longest fitting rule wins, and rules win over the list.

All entries, canonical URLs, hosts of rules and rules, are keys of one blocked Bloom filter: a key's first
hash picks a block of eight words, its second one a bit in each of them. The keys that a url could match are
tested against it, and what passes meets the entries in hash joins on whole keys, which removes
the false positives. What a url could match: its canonical form; the suffixes of its host, of no more labels
than a rule has; and for hosts that rules name, the prefixes of its path in the lengths of those rules.

The filter has at most MOST_BLOCKS blocks of 32 bytes, so it may be broadcast whatever the list's size; a list
too long for it passes more false positives to the joins, and the result stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import table
from textmill.llm.registry import query
from textmill.operators.skew import lookup_join
from textmill.sources.scratch import checkpoint

BITS_PER_KEY = 16
BLOCK_BITS, BLOCK_WORDS = 256, 8
MOST_BLOCKS = 1 << 17  # 4 MB of words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"  # parameters that do not change the page
# Fixed values of the query: the rules, and the words that make a host's pages listed.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
LISTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")


def host_of(url: Column) -> Column:
    """From after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty for null and without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From after the host up to `?`, `#` or the end; empty for null and without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without a last `/`, and the sorted parameters that are no tracking ones; null where no host is.

    Scheme, fragment and the order of parameters do not count.
    """
    host, path = host_of(url), path_of(url)
    asked = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.sort_array(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    given = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/$", ""), given))


def _positions(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """(block, the bit of each of its words) of a key."""
    bits = F.xxhash64(key, F.lit("bits"))
    words = [F.call_function("shiftleft", F.lit(1), F.shiftright(bits, 5 * i).bitwiseAND(31).cast("int")) for i in range(BLOCK_WORDS)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), words


def bloom_filter(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """((block, w0 .. w7), number of blocks) of ``keys(key)``: at most MOST_BLOCKS rows."""
    blocks = 1
    while blocks < MOST_BLOCKS and blocks * BLOCK_BITS < BITS_PER_KEY * n_keys:
        blocks *= 2
    block, words = _positions(F.col("key"), blocks)
    marked = keys.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)]), blocks


def possible(df: DataFrame, key: Column, bloom: tuple[DataFrame, int]) -> DataFrame:
    """The rows of ``df`` whose key may be in the filter; null keys are not."""
    filter_, blocks = bloom
    block, words = _positions(key, blocks)
    sent = F.broadcast(filter_.select(F.col("block").alias("__block"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(BLOCK_WORDS)]))
    asked = df.filter(key.isNotNull()).withColumn("__at", block)
    for i, w in enumerate(words):
        asked = asked.withColumn(f"__m{i}", w)
    held = (F.col("__at") == F.col("__block")) & (F.col("__w0").bitwiseAND(F.col("__m0")) == F.col("__m0"))
    for i in range(1, BLOCK_WORDS):
        held &= F.col(f"__w{i}").bitwiseAND(F.col(f"__m{i}")) == F.col(f"__m{i}")
    return asked.join(sent, held).select(*df.columns)


def _host_key(host: Column) -> Column:
    return F.concat(F.lit("h "), host)


def _rule_key(rule: Column) -> Column:
    return F.concat(F.lit("r "), rule)


def _url_key(url: Column) -> Column:
    return F.concat(F.lit("u "), url)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block) as last columns.

    ``rules(host, path, verdict)`` hold hosts in lower case; rows with a null are left out, and of rules with the
    same host and path a blocking one counts. The longest rule (by characters of host and path together, then of
    the host) that fits gives the verdict and is named in ``rule``. Without one, ``rule`` is null and the verdict
    is block if ``listed(url)`` holds a url of the same canonical form, else allow. A null url, or one without
    `://`, has an empty host and path and is allowed. Repeated rows stay, other columns pass through; columns of
    the input named as a new one are replaced. Empty tables of pages, rules or listed urls are fine.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # '/' belongs to no host, so host and path together name one rule
    entries = checkpoint(
        rules.filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select("host", "path", "verdict", F.concat("host", F.lit("\n"), "path").alias("rule_key"))
    )
    named = entries.groupBy("host").agg(
        F.sort_array(F.collect_set(F.length("path"))).alias("lengths"),  # of one host's rules: at most a path's longest length
        F.max(F.size(F.split("host", r"\."))).alias("labels"),
    )
    blocked = checkpoint(listed.select(canonical(F.col("url")).alias("listed_url")).filter("listed_url IS NOT NULL").distinct())
    keys = checkpoint(
        entries.select(_rule_key(F.col("rule_key")).alias("key"))
        .union(entries.select(_host_key(F.col("host"))).distinct())
        .union(blocked.select(_url_key(F.col("listed_url"))))
    )
    bloom = bloom_filter(keys, keys.count())
    bloom = (checkpoint(bloom[0]), bloom[1])
    most_labels = named.agg(F.max("labels")).first()[0] or 0

    # each distinct place (host and path) of a url is matched once
    places = pages.select(host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    places = places.filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    last = F.least(F.size(labels), F.lit(most_labels))
    suffixes = places.filter(F.lit(most_labels) > 0).select(
        "host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                                              lambda n: F.array_join(F.slice(labels, -n, n), "."))).alias("suffix"))
    on_host = lookup_join(possible(suffixes, _host_key(F.col("suffix")), bloom), named.select(F.col("host").alias("suffix"), "lengths"), "suffix")
    prefixes = on_host.select("host", "path", "suffix", F.explode("lengths").alias("n")).filter(F.col("n") <= F.length("path"))
    prefixes = prefixes.select(
        "host", "path", F.concat("suffix", F.lit("\n"), F.expr("substring(path, 1, n)")).alias("rule_key")
    )
    fitting = lookup_join(
        possible(prefixes, _rule_key(F.col("rule_key")), bloom),
        entries.select("rule_key", "verdict", F.length("host").alias("host_length"), F.length("path").alias("path_length")),
        "rule_key",
    )
    rank = F.struct((F.col("host_length") + F.col("path_length")).alias("size"), "host_length", "rule_key", F.col("verdict"))
    longest = fitting.groupBy("host", "path").agg(F.max(rank).alias("r"))
    ruled = longest.select("host", "path", F.translate("r.rule_key", "\n", "").alias("rule"), F.col("r.verdict").alias("rule_verdict"))

    forms = pages.select(canonical(F.col(f"`{url}`")).alias("form")).filter("form IS NOT NULL")
    hits = possible(forms, _url_key(F.col("form")), bloom).distinct()
    hits = hits.join(blocked, hits["form"] == blocked["listed_url"], "left_semi").select("form", F.lit(True).alias("is_listed"))

    # hot places and urls are on the large side of these joins only, whose partitions Spark splits
    rows = pages.select(F.struct(*[f"`{c}`" for c in kept]).alias("row"), F.col(f"`{url}`").alias("url"))
    rows = rows.select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("form"))
    found = rows.join(ruled, ["host", "path"], "left").join(hits, "form", "left")
    own = F.when(F.col("is_listed"), "block").otherwise("allow")
    return found.select("row.*", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"))


def listed_by_host(pages: DataFrame, words: tuple[str, ...] = LISTED_WORDS) -> DataFrame:
    """(url) of all pages whose host has one of ``words`` between its dots and hyphens."""
    return pages.filter(F.arrays_overlap(F.split(host_of(F.col("url")), r"[.-]"), F.array(*map(F.lit, words)))).select("url")


def _sql() -> str:
    """Rules by their definition; listed are urls whose canonical form a page of a listed host has."""
    fixed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    words = ", ".join(f"'{w}'" for w in LISTED_WORDS)
    return rf"""
        WITH cut AS (SELECT page_id, coalesce(url, '') AS url,
            translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        forms AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/$', '')
            || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
                 lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))), '&'), ''), '') END AS form FROM cut),
        rules(rule_host, rule_path, verdict) AS (VALUES {fixed}),
        fits AS (SELECT host, path, rule_host || rule_path AS rule, verdict,
            row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host) + length(rule_path) DESC, length(rule_host) DESC) AS r
          FROM (SELECT DISTINCT host, path FROM cut) AS p JOIN rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
        listed AS (SELECT DISTINCT form FROM forms WHERE form IS NOT NULL AND list_has_any(regexp_split_to_array(host, '[.-]'), [{words}]))
        SELECT f.page_id, f.host, f.path, b.rule,
          coalesce(b.verdict, CASE WHEN l.form IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
        FROM forms AS f LEFT JOIN fits AS b ON f.host = b.host AND f.path = b.path AND b.r = 1 LEFT JOIN listed AS l ON f.form = l.form"""


@query("op12_url_filter", _sql())
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the pages of hosts with a listed word; that list grows with the pages, the rules are fixed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(pages, rules, listed_by_host(pages)).select("page_id", "host", "path", "rule", "verdict")
