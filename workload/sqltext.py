"""SQL fragments of the check queries (DuckDB), written apart from the library's expressions."""

from __future__ import annotations

from textmill.functions.stopwords import ENGLISH
from textmill.functions.text import NEGATIVE_MARKERS, POSITIVE_MARKERS

S = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\p{Z}"
W = r"\p{L}\p{N}_"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def strip(x: str) -> str:
    return sub(x, f"^[{S}]+|[{S}]+$", "")


def no_mentions(x: str) -> str:
    return sub(sub(x, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", " "), f"@[{W}]+", " ")


def no_html(x: str) -> str:
    return sub(x, "<[^>]+>", " ")


def no_punct(x: str) -> str:
    return sub(x, f"[^{W}{S}]", " ")


def one_space(x: str) -> str:
    return strip(sub(x, f"[{S}]+", " "))


def no_urls(x: str) -> str:
    return strip(sub(x, rf"https?://[^{S}]+|www\.[^{S}]+", ""))


def any_of(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in markers) + ")"


def contradictory(x: str) -> str:
    return any_of(x, POSITIVE_MARKERS) + " AND " + any_of(x, NEGATIVE_MARKERS)


def words(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[{S}]+'), lambda w: w <> '')"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def hits(x: str, keywords) -> str:
    return "(" + " + ".join(f"CAST(contains(lower(coalesce({x}, '')), '{k}') AS INT)" for k in keywords) + ")"


def lang_hits(x: str, profile) -> str:
    return (
        f"len(list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}]+'), lambda w: w IN {in_list(profile)}))"
    )


def chain(source: str, key: str, column: str) -> str:
    """CTE cleaned(key, text, reason) for the default text options."""
    return f"""
      s1 AS (SELECT {key}, coalesce({column}, '') AS raw FROM {source}),
      s2 AS (SELECT {key}, raw, {no_html(no_mentions("replace(raw, '#', '')"))} AS marked FROM s1),
      s3 AS (SELECT {key}, raw, marked, {no_urls(one_space(no_punct("marked")))} AS last FROM s2),
      s4 AS (SELECT {key}, last, CASE WHEN raw = '' THEN 'Absent_text'
          WHEN starts_with(raw, 'RT ') OR starts_with(raw, 'RT@') THEN 'Retweet'
          WHEN {contradictory("marked")} THEN 'positive_and_negative'
          WHEN last = '' THEN 'empty_after_cleaning' END AS reason FROM s3),
      cleaned AS (SELECT {key}, CASE WHEN reason IS NULL THEN last ELSE '' END AS text, reason FROM s4)"""


def tfidf(source: str, text: str, max_features: int = 5000) -> str:
    """CTE weights(row_idx, term, weight) and vocab(term, freq, df)."""
    return f"""
      raw_terms AS (SELECT row_idx, unnest(regexp_extract_all(lower({text}), '[{W}]{{2,}}')) AS term FROM {source}),
      tf AS (SELECT row_idx, term, count(*) AS tf FROM raw_terms WHERE term NOT IN {in_list(ENGLISH)} GROUP BY ALL),
      vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS freq, count(*) AS df FROM tf GROUP BY term
                ORDER BY freq DESC, term LIMIT {max_features}),
      raw_weights AS (SELECT row_idx, term, tf * (ln((1 + (SELECT count(*) FROM {source})) / (1 + df)) + 1) AS w
                      FROM tf JOIN vocab USING (term)),
      norms AS (SELECT row_idx, sqrt(sum(w * w)) AS norm FROM raw_weights GROUP BY row_idx),
      weights AS (SELECT row_idx, term, w / norm AS weight FROM raw_weights JOIN norms USING (row_idx))"""


def split(source: str = "labelled", size: float = 0.2) -> str:
    """CTE parts(row_idx, text, target, is_validation)."""
    return f"""
      parts AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5('42:' || row_idx), row_idx)
          <= round(count(*) OVER (PARTITION BY target) * {size}) AS is_validation FROM {source})"""


def grams(x: str, ngram: str, binary: bool) -> str:
    two = f"[{x}[i] || '_' || {x}[i + 1] for i in range(1, len({x}))]"
    three = f"[{x}[i] || '_' || {x}[i + 1] || '_' || {x}[i + 2] for i in range(1, len({x}) - 1)]"
    out = {"unigram": x, "bigram": f"list_concat({x}, {two})", "trigram": f"list_concat({x}, {two}, {three})"}[ngram]
    return f"list_distinct({out})" if binary else out


def naive_bayes(ngram: str = "unigram", binary: bool = False, scored: str = "SELECT row_idx, text FROM parts WHERE is_validation") -> str:
    """CTEs counts, classes, vocab_size, scores(row_idx, target, score), best(row_idx, predicted, score)."""
    return f"""
      train_words AS (SELECT target, {words("text")} AS ws FROM parts WHERE NOT is_validation),
      counts AS (SELECT token, target, count(*) AS n FROM
          (SELECT target, unnest({grams("ws", ngram, binary)}) AS token FROM train_words) GROUP BY ALL),
      vocab_size AS (SELECT count(DISTINCT token) AS v FROM counts),
      class_rows AS (SELECT target, count(*) AS rows, ln(count(*) / (SELECT count(*) FROM train_words)) AS log_prior
                     FROM train_words GROUP BY target),
      classes AS (SELECT c.target, rows, log_prior, coalesce(sum(n), 0) AS total FROM class_rows c
                  LEFT JOIN counts t ON t.target = c.target GROUP BY ALL),
      scored AS ({scored}),
      query_words AS (SELECT row_idx, {words("text")} AS ws FROM scored),
      query_tokens AS (SELECT row_idx, token, count(*) AS times FROM
          (SELECT row_idx, unnest({grams("ws", ngram, binary)}) AS token FROM query_words) GROUP BY ALL),
      known AS (SELECT q.* FROM query_tokens q WHERE token IN (SELECT token FROM counts)),
      parts_of_score AS (
          SELECT row_idx, c.target, times * ln((coalesce(t.n, 0) + 1) / (c.total + (SELECT v FROM vocab_size))) AS part
          FROM known k CROSS JOIN classes c LEFT JOIN counts t ON t.token = k.token AND t.target = c.target
          UNION ALL SELECT row_idx, target, log_prior FROM scored CROSS JOIN classes),
      scores AS (SELECT row_idx, target, round(sum(part), 6) AS score FROM parts_of_score GROUP BY ALL),
      best AS (SELECT row_idx, target AS predicted, score FROM scores
               QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY score DESC, target) = 1)"""


def neighbours(k: int = 5) -> str:
    """CTEs found(row_idx, neighbour, target, distance, rank) and best(row_idx, predicted, votes)."""
    return f"""
      word_sets AS (SELECT row_idx, target, is_validation, list_distinct({words("text")}) AS ws FROM parts),
      set_words AS (SELECT row_idx, is_validation, unnest(ws) AS w FROM word_sets),
      shared AS (SELECT a.row_idx AS i, b.row_idx AS j, count(*) AS n FROM set_words a JOIN set_words b
                 ON a.w = b.w AND a.is_validation AND NOT b.is_validation GROUP BY ALL),
      distances AS (SELECT a.row_idx, b.row_idx AS neighbour, b.target,
          CASE WHEN len(a.ws) + len(b.ws) = 0 THEN 0.0
               ELSE 1.0 - coalesce(n, 0) / CAST(len(a.ws) + len(b.ws) - coalesce(n, 0) AS DOUBLE) END AS distance
          FROM word_sets a JOIN word_sets b ON a.is_validation AND NOT b.is_validation
          LEFT JOIN shared ON i = a.row_idx AND j = b.row_idx),
      found AS (SELECT *, CAST(row_number() OVER (PARTITION BY row_idx ORDER BY distance, target, neighbour) AS INT) AS rank
                FROM distances QUALIFY rank <= {k}),
      votes AS (SELECT row_idx, target, count(*) AS votes FROM found GROUP BY ALL),
      best AS (SELECT row_idx, target AS predicted, votes FROM votes
               QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY votes DESC, target) = 1)"""


def near_pairs(source: str, text: str, limit: float) -> str:
    """CTE near(i, j, distance, copies_i, copies_j) over distinct word sets."""
    return f"""
      all_sets AS (SELECT row_idx, list_sort(list_distinct({words(text)})) AS ws FROM {source}),
      sets AS (SELECT min(row_idx) AS gid, count(*) AS copies, ws FROM all_sets GROUP BY ws),
      set_words AS (SELECT gid, unnest(ws) AS w FROM sets),
      shared AS (SELECT a.gid AS i, b.gid AS j, count(*) AS n FROM set_words a JOIN set_words b
                 ON a.w = b.w AND a.gid < b.gid GROUP BY ALL),
      near AS (SELECT i, j, 1.0 - n / CAST(len(a.ws) + len(b.ws) - n AS DOUBLE) AS distance,
                      a.copies AS copies_i, b.copies AS copies_j
               FROM shared JOIN sets a ON a.gid = i JOIN sets b ON b.gid = j
               WHERE 1.0 - n / CAST(len(a.ws) + len(b.ws) - n AS DOUBLE) <= {limit} + 1e-9)"""


def all_pairs(source: str, text: str) -> str:
    """CTE near(i, j, distance, copies_i, copies_j) over all pairs of distinct word sets; a set with copies is paired with itself, too."""
    return f"""
      all_sets AS (SELECT row_idx, list_sort(list_distinct({words(text)})) AS ws FROM {source}),
      sets AS (SELECT min(row_idx) AS gid, count(*) AS copies, ws FROM all_sets GROUP BY ws),
      set_words AS (SELECT gid, unnest(ws) AS w FROM sets),
      shared AS (SELECT a.gid AS i, b.gid AS j, count(*) AS n FROM set_words a JOIN set_words b
                 ON a.w = b.w AND a.gid < b.gid GROUP BY ALL),
      near AS (SELECT a.gid AS i, b.gid AS j, 1.0 - coalesce(n, 0) / CAST(len(a.ws) + len(b.ws) - coalesce(n, 0) AS DOUBLE) AS distance,
                      a.copies AS copies_i, b.copies AS copies_j
               FROM sets a JOIN sets b ON a.gid < b.gid LEFT JOIN shared ON i = a.gid AND j = b.gid
               UNION ALL SELECT gid, gid, 0.0, copies, copies FROM sets WHERE copies > 1 AND gid IS NOT NULL)"""


def metrics(source: str) -> str:
    """CTEs cells, labels, grid(actual, predicted, n), per_label, one(accuracy, precision, recall, f1, error_rate)."""
    return f"""
      judged AS (SELECT actual, predicted FROM {source} WHERE actual IS NOT NULL AND predicted IS NOT NULL),
      cells AS (SELECT actual, predicted, count(*) AS n FROM judged GROUP BY ALL),
      all_labels AS (SELECT actual AS label FROM judged UNION SELECT predicted FROM judged),
      grid AS (SELECT a.label AS actual, p.label AS predicted, CAST(coalesce(n, 0) AS BIGINT) AS n
               FROM all_labels a CROSS JOIN all_labels p
               LEFT JOIN cells c ON c.actual = a.label AND c.predicted = p.label),
      margins AS (SELECT label, sum(n) FILTER (actual = label) AS support, sum(n) FILTER (predicted = label) AS chosen,
                         sum(n) FILTER (actual = label AND predicted = label) AS hits
                  FROM all_labels JOIN grid ON actual = label OR predicted = label GROUP BY label),
      ratios AS (SELECT *, CASE WHEN chosen > 0 THEN hits / chosen ELSE 0 END AS p,
                        CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM margins),
      per_label AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM ratios),
      one AS (SELECT round((SELECT sum(n) FILTER (actual = predicted) / sum(n) FROM grid), 6) AS accuracy,
                     round(sum(p * support) / sum(support), 6) AS precision,
                     round(sum(r * support) / sum(support), 6) AS recall,
                     round(sum(f * support) / sum(support), 6) AS f1,
                     round(1 - (SELECT sum(n) FILTER (actual = predicted) / sum(n) FROM grid), 6) AS error_rate
              FROM per_label)"""
