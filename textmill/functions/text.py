"""Text normalisation as Column expressions. Nothing here needs a Python UDF."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.language import by_function_words
from textmill.options import TextOptions

# The result depends on these patterns and marker lists.
SPACE = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x20\x{85}\x{A0}\p{Z}"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"_\p{L}\p{N}"
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MENTION_PATTERN = f"@[{WORD}]+"
TAG_PATTERN = r"<[^>]+>"
PUNCTUATION_PATTERN = f"[^{WORD}{SPACE}]"
URL_PATTERN = f"https?://[^{SPACE}]+|www\\.[^{SPACE}]+"
RETWEET_PATTERN = "^RT[ @]"
MARKER_START_PATTERN = r"[:;<^\x{2639}\x{1F400}-\x{1F9FF}]"
POSITIVE_MARKERS = [
    "😀", "😃", "😄", "😁", "😊", "😍", "🥰", "👍", "🤩", "😂", "😎", "😉", "😘",
    ":)", ":-)", ";)", ";-)", "<3", "^^",
]
NEGATIVE_MARKERS = [
    "😠", "😡", "😢", "😭", "☹️", "😞", "👎", "🤬", "😒", "😕", "🙁", "😩", "😤",
    ":(", ":-(", ";(", ";-(",
]


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.trim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    """True for NULL, for the empty string and for white space only."""
    return c.isNull() | ~c.rlike(f"[^{SPACE}]")


def is_retweet(c: Column) -> Column:
    return c.rlike(RETWEET_PATTERN)


def strip_hashtags(c: Column) -> Column:
    return F.replace(c, F.lit("#"), F.lit(""))


def strip_mentions(c: Column) -> Column:
    """Blank e-mail addresses, then @names; texts without an @ skip both patterns."""
    blanked = F.regexp_replace(F.regexp_replace(c, EMAIL_PATTERN, " "), MENTION_PATTERN, " ")
    return F.when(c.contains("@"), blanked).otherwise(c)


def strip_html(c: Column) -> Column:
    return F.when(c.contains("<"), F.regexp_replace(c, TAG_PATTERN, " ")).otherwise(c)


def _has_any(c: Column, markers: Sequence[str]) -> Column:
    return reduce(or_, (c.contains(m) for m in markers))


def is_contradictory(c: Column) -> Column:
    """A positive and a negative marker in one text; most texts hold no character a marker starts with."""
    return c.rlike(MARKER_START_PATTERN) & _has_any(c, POSITIVE_MARKERS) & _has_any(c, NEGATIVE_MARKERS)


def strip_punctuation(c: Column) -> Column:
    """Blank whatever is neither a letter, a digit, an underscore nor white space."""
    return F.regexp_replace(c, PUNCTUATION_PATTERN, " ")


def collapse_spaces(c: Column) -> Column:
    """One space per run of white space, none at the ends; single spaces are not rewritten."""
    return strip(F.regexp_replace(c, f"(?! [^{SPACE}])[{SPACE}]+", " "))


def strip_urls(c: Column) -> Column:
    has_url = c.contains("http") | c.contains("www.")
    return strip(F.when(has_url, F.regexp_replace(c, URL_PATTERN, "")).otherwise(c))


def truncate(c: Column, width: int = 200) -> Column:
    """Cut a text for display."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def clean_text(
    df: DataFrame, column: str, options: TextOptions, out: str = "cleaned", reason: str = "reason", detect=by_function_words
) -> DataFrame:
    """Add ``out`` (cleaned text, '' when refused) and ``reason`` (the step that refused it).

    ``detect(df, text, out)`` adds a column's language; ``operators.language.by_model`` goes by a counted model.

    Each intermediate text that is read more than once is its own projection. The result passes
    through a one-element ``explode``: a filter on the cleaned text would otherwise be pushed below
    the projections and repeat the whole chain of patterns inside its condition.
    """
    raw, marked, plain, lang, last = (f"__{column}_{s}" for s in ("raw", "marked", "plain", "lang", "last"))
    df = df.withColumn(raw, F.coalesce(F.col(column), F.lit("")))

    text = F.col(raw)
    if options.hashtags:
        text = strip_hashtags(text)
    if options.mentions:
        text = strip_mentions(text)
    if options.html:
        text = strip_html(text)
    df = df.withColumn(marked, text)

    text = F.col(marked)
    if options.urls and options.urls_first:
        text = strip_urls(text)
    if options.punctuation:
        text = strip_punctuation(text)
    df = df.withColumn(plain, text)

    refusals = [(F.col(raw) == "", "Absent_text")]
    if options.retweets:
        refusals.append((is_retweet(F.col(raw)), "Retweet"))
    if options.contradictory:
        refusals.append((is_contradictory(F.col(marked)), "positive_and_negative"))
    if options.only_french or options.only_english:
        # an undetermined language keeps the text
        df = detect(df, plain, lang)
        if options.only_french:
            refusals.append((F.col(lang) != "fr", "not_french"))
        if options.only_english:
            refusals.append((F.col(lang) != "en", "not_english"))

    text = F.col(plain)
    if options.spaces:
        text = collapse_spaces(text)
    if options.urls:
        text = strip_urls(text)
    df = df.withColumn(last, text)
    refusals.append((F.col(last) == "", "empty_after_cleaning"))

    done = F.struct(F.coalesce(*(F.when(test, F.lit(name)) for test, name in refusals)).alias("why"), F.col(last).alias("text"))
    kept = [c for c in df.columns if c not in (raw, marked, plain, lang, last)]
    df = df.select(*kept, F.explode(F.array(done)).alias("__done"))
    why = F.col("__done.why")
    return df.select(*kept, why.alias(reason), F.when(why.isNull(), F.col("__done.text")).otherwise("").alias(out))
