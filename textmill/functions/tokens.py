"""Tokens, n-grams and set distance as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmill.functions.text import SPACE, WORD

# Term pattern and n-gram sizes of the public option names.
TERM_PATTERN = f"([{WORD}]{{2,}})"
NGRAM_SIZES = {"unigram": 1, "bigram": 2, "trigram": 3}


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``; a lambda would evaluate it per element."""
    return F.transform(F.array(value), body)[0]


def words(c: Column) -> Column:
    """Lower-cased white-space tokens, empty array for NULL."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), f"[{SPACE}]+")
    return F.filter(parts, lambda w: w != "")


def word_set(c: Column) -> Column:
    return F.array_distinct(words(c))


def ngrams(tokens: Column, ngram: str = "unigram") -> Column:
    """Words followed by their 2-grams (and 3-grams), joined with an underscore."""
    sizes = range(2, NGRAM_SIZES.get(ngram, 1) + 1)
    if not sizes:
        return tokens

    def all_grams(ws: Column) -> Column:
        grams = [ws]
        for n in sizes:
            # each n-gram is the (n-1)-gram at its place followed by the word n-1 places further on
            longer = F.zip_with(grams[-1], F.slice(ws, n, F.size(ws)), lambda g, w: F.concat(g, F.lit("_"), w))
            grams.append(F.filter(longer, lambda g: g.isNotNull()))
        return F.concat(*grams)

    return bind(tokens, all_grams)


def token_counts(tokens: Column) -> Column:
    """Array of (token, n) structs: how often each token occurs in the array, without leaving the row.

    Equal tokens are neighbours once sorted; a token's count is the distance from its first place to the
    next token's.
    """

    def counted(t: Column) -> Column:
        last = F.size(t) - 1
        starts = F.filter(
            F.transform(t, lambda w, i: F.when((i == 0) | (w != F.get(t, i - 1)), i)), lambda i: i.isNotNull()
        )
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(last + 1))
        return F.zip_with(
            starts, ends, lambda a, b: F.struct(F.get(t, a).alias("token"), (b - a).cast("bigint").alias("n"))
        )

    return bind(
        F.sort_array(tokens), lambda t: F.when(F.size(t) > 0, counted(t)).otherwise(F.array().cast("array<struct<token:string,n:bigint>>"))
    )


def terms(c: Column) -> Column:
    """Runs of two or more word characters, lower-cased (the vectoriser's tokens)."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM_PATTERN), F.lit(1))


def set_distance(a: Column, b: Column) -> Column:
    """Jaccard distance of two sets given as arrays without repeats; two empty sets are equal."""
    shared = F.size(F.array_intersect(a, b))
    return bind(
        F.struct(shared.alias("shared"), (F.size(a) + F.size(b)).alias("both")),
        lambda s: F.when(s["both"] == 0, 0.0).otherwise(1.0 - s["shared"] / (s["both"] - s["shared"])),
    )


def jaccard_distance(a: Column, b: Column) -> Column:
    """Jaccard distance of the word sets of two texts."""
    sets = F.struct(word_set(a).alias("a"), word_set(b).alias("b"))
    return bind(sets, lambda s: set_distance(s["a"], s["b"]))
