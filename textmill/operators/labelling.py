"""Manual and keyword labels, cluster labels, alignment and summaries."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.tokens import bind
from textmill.operators.keywords import meet_words
from textmill.options import NEGATIVE, NEUTRAL, POSITIVE, UNLABELLED
from textmill.sources.scratch import checkpoint

# Label names that stand for the polar classes.
LABEL_NAMES = {
    "positive": POSITIVE, "positives": POSITIVE, "pos": POSITIVE, "4": POSITIVE,
    "negative": NEGATIVE, "negatives": NEGATIVE, "neg": NEGATIVE, "0": NEGATIVE,
}
LABELS = (NEGATIVE, NEUTRAL, POSITIVE)


def label_manual(
    df: DataFrame,
    annotations: DataFrame,
    row_idx: str = "row_idx",
    target: str = "target",
    stop_early: bool = False,
) -> DataFrame:
    """Apply (seq, row_idx, label); the last annotation of a row wins, unknown rows are ignored."""
    last = annotations.groupBy(row_idx).agg(F.max_by("label", "seq").alias("__label"))
    old = [F.col(target)] if target in df.columns else []
    labelled = df.join(last, row_idx, "left").withColumn(
        target, F.coalesce("__label", *old, F.lit(UNLABELLED)).cast("int")
    )
    labelled = labelled.drop("__label")
    return labelled.filter(F.col(target) != UNLABELLED) if stop_early else labelled


def keyword_hits(c: Column, words: Sequence[str]) -> Column:
    """How many listed words occur in the lower-cased text, as substrings."""
    listed = F.array(*(F.lit(w.lower()) for w in words)) if words else F.array().cast("array<string>")
    lowered = F.lower(F.coalesce(c, F.lit("")))
    return bind(lowered, lambda text: F.size(F.filter(listed, lambda w: F.contains(text, w))))


def label_value(name: str) -> int:
    return LABEL_NAMES.get(name.lower(), NEUTRAL)


def label_by_keywords(c: Column, keyword_map: Mapping[str, Sequence[str]]) -> Column:
    """Label with the most hits, neutral without hits; the first label of the map wins a tie."""
    if not keyword_map:
        raise ValueError("no keywords given")
    scores = F.array(
        *(
            F.struct(
                keyword_hits(c, words).alias("hits"),
                F.lit(-order).alias("order"),
                F.lit(label_value(name)).alias("label"),
            )
            for order, (name, words) in enumerate(keyword_map.items())
        )
    )
    return bind(F.array_max(scores), lambda best: F.when(best["hits"] > 0, best["label"]).otherwise(NEUTRAL))


def classify_by_keywords(c: Column, positives: Sequence[str], negatives: Sequence[str]) -> Column:
    """More positive words: 4, more negative words: 0, equal counts: 2. Repeated list words count once."""
    pos = keyword_hits(c, sorted({w.lower() for w in positives}))
    neg = keyword_hits(c, sorted({w.lower() for w in negatives}))
    more = F.struct(pos.alias("pos"), neg.alias("neg"))
    return bind(
        more, lambda m: F.when(m["pos"] > m["neg"], POSITIVE).when(m["neg"] > m["pos"], NEGATIVE).otherwise(NEUTRAL)
    )


def keyword_matches(df: DataFrame, text: str, words: DataFrame, row_idx: str = "row_idx") -> DataFrame:
    """(row_idx, word): which words of a table ``words(word)`` of any size a lower-cased text contains, as substrings.

    Texts and words meet in blocks, see ``meet_words``. Rows need different numbers; blank words and null ones are left out.
    """

    def found(texts: pa.Table, listed: pa.Table, at: int, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, held = np.nonzero(seen)
        pairs = pa.table({row_idx: texts["id"].take(pa.array(rows + at)), "word": listed["text"].take(pa.array(held))})
        yield from pairs.combine_chunks().to_batches()

    kind = df.schema[row_idx].dataType.simpleString()
    listed = words.select(F.lower("word").alias("text"), F.lit(None).cast("int").alias("tags")).filter("text <> ''").distinct()
    return meet_words(_lowered(df, text, row_idx), listed, found, f"`{row_idx}` {kind}, word string")


def _lowered(df: DataFrame, text: str, row_idx: str) -> DataFrame:
    return df.select(F.col(row_idx).alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))


def label_by_keyword_tables(
    df: DataFrame, text: str, words_by_label: Mapping[str, DataFrame], row_idx: str = "row_idx", target: str = "target"
) -> DataFrame:
    """``df`` with the label of ``label_by_keywords``, from word tables of any size: (word) for each label name.

    Words stay tables; no list is collected. A word counts once for each label that lists it. Words are counted where texts
    meet them, so that what goes on are at most the labels of a text for each block of words.
    """
    tables = [w.select(F.lower("word").alias("text"), F.lit(order).alias("order")) for order, w in enumerate(words_by_label.values())]
    if not tables:
        raise ValueError("no keywords given")
    listed = checkpoint(reduce(DataFrame.unionByName, tables).filter("text <> ''").groupBy("text").agg(F.collect_set("order").alias("tags")))

    def found(texts: pa.Table, words: pa.Table, at: int, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
        tags = words["tags"].combine_chunks()
        word, order = np.repeat(np.arange(len(tags)), tags.value_lengths().to_numpy()), tags.flatten().to_numpy()
        for label in np.unique(order):
            hits = np.count_nonzero(seen[:, word[order == label]], axis=1)
            rows = np.flatnonzero(hits)
            counted = pa.table({"id": texts["id"].take(pa.array(rows + at)), "order": pa.array(np.full(len(rows), label, np.int32)), "hits": pa.array(hits[rows])})
            yield from counted.combine_chunks().to_batches()

    kind = df.schema[row_idx].dataType.simpleString()
    counts = meet_words(_lowered(df, text, row_idx), listed, found, f"id {kind}, order int, hits long")
    per_label = counts.groupBy(F.col("id").alias(row_idx), "order").agg(F.sum("hits").alias("hits"))
    best = per_label.groupBy(row_idx).agg(F.max(F.struct("hits", (-F.col("order")).alias("rank"))).alias("best"))
    values = F.array(*[F.lit(label_value(name)) for name in words_by_label])
    label = F.coalesce(F.get(values, -F.col("best.rank")), F.lit(NEUTRAL))
    return df.drop(target).join(best, row_idx, "left").withColumn(target, label.cast("int")).drop("best")


def label_clusters(df: DataFrame, cluster: str = "cluster", target: str = "target") -> DataFrame:
    """The three smallest cluster ids become 0, 2 and 4; every other one and noise become 2."""
    first = df.filter(F.col(cluster) >= 0).select(cluster).distinct().orderBy(cluster).limit(len(LABELS))
    ranked = first.agg(F.array_sort(F.collect_list(cluster))).scalar()
    position = F.array_position(ranked, F.col(cluster))
    labels = F.array(*(F.lit(v) for v in LABELS))
    return df.withColumn(
        target, F.when(position > 0, F.element_at(labels, position.cast("int"))).otherwise(NEUTRAL)
    )


def align_clusters(df: DataFrame, actual: str, cluster: str, out: str = "aligned") -> DataFrame:
    """Replace cluster ids by labels through the one-to-one mapping with the most matches.

    With L labels an optimal mapping only uses the L best clusters of each label (or the smallest
    ids, for empty cells), so at most L*L counted cells leave the cluster, whatever the number of rows.
    """
    cells = df.groupBy(actual, cluster).agg(F.count("*").alias("n"))
    labels = [r[0] for r in df.select(actual).distinct().orderBy(actual).collect()]
    best = Window.partitionBy(actual).orderBy(F.desc("n"), cluster)
    top = cells.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= len(labels)).collect()
    small = [
        r[0] for r in df.select(cluster).distinct().orderBy(cluster).limit(2 * len(labels)).collect()
    ]
    hits = {(r[actual], r[cluster]): r["n"] for r in top}
    ids = sorted({r[cluster] for r in top} | set(small))
    chosen = best_mapping(labels, ids, hits)
    pairs = [F.lit(v) for label, c in chosen.items() for v in (c, label)]
    mapping = F.create_map(*pairs)
    return df.withColumn(out, F.coalesce(mapping[F.col(cluster)], F.lit(labels[0])))


def best_mapping(labels: Sequence, ids: Sequence, hits: Mapping[tuple, int]) -> dict:
    """One id for each label, none twice, with the most hits; the first labels get the smallest ids on a tie.

    Labels are served one after the other. Each one takes the cheapest chain in which it takes an id, whose label moves on
    to another id, and so on to a free one; prices of labels and ids keep all steps of such chains from being negative
    (shortest augmenting paths), so the work is labels squared times ids. Places count below a single hit, which
    settles ties.
    """
    slots = [*ids, *[None] * max(0, len(labels) - len(ids))]
    base = len(slots) + 1
    unit = [base ** (len(labels) - 1 - k) for k in range(len(labels))]
    cost = [[place * unit[k] - hits.get((label, c), 0) * base ** len(labels) for place, c in enumerate(slots)] for k, label in enumerate(labels)]
    label_price, slot_price, holder = [0] * len(labels), [0] * len(slots), [None] * len(slots)
    for new in range(len(labels)):
        distance, origin, reached = [None] * len(slots), [None] * len(slots), {}
        label, at, walked = new, None, 0
        while True:
            for place in range(len(slots)):
                if place in reached:
                    continue
                step = walked + cost[label][place] - label_price[label] - slot_price[place]
                if distance[place] is None or step < distance[place]:
                    distance[place], origin[place] = step, at
            at = min((p for p in range(len(slots)) if p not in reached), key=lambda p: distance[p])
            walked = distance[at]
            if holder[at] is None:
                break
            reached[at] = walked
            label = holder[at]
        label_price[new] += walked
        for place, when in reached.items():
            label_price[holder[place]] += walked - when
            slot_price[place] -= walked - when
        # everyone on the chain moves up
        while at is not None:
            before = origin[at]
            holder[at] = new if before is None else holder[before]
            at = before
    return {labels[k]: slots[place] for place, k in sorted(((p, k) for p, k in enumerate(holder) if k is not None), key=lambda x: x[1]) if slots[place] is not None}


def label_summary(df: DataFrame, target: str = "target") -> DataFrame:
    """One row with totals and the number of rows per label."""
    t = F.col(target)
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(t.isin(NEGATIVE, POSITIVE)).alias("labeled"),
        F.count_if(t == NEUTRAL).alias("neutral"),
        F.count_if(t.isNull() | (t == UNLABELLED)).alias("unlabeled_rows"),
        F.count_if(t.isNotNull() & (t != UNLABELLED)).alias("labeled_rows"),
        *(F.count_if(t == v).alias(f"label_{v}") for v in LABELS),
    )


def label_percentages(df: DataFrame, target: str = "target") -> DataFrame:
    """(label, n, percent) for 0, 2 and 4; 0 percent when there are no rows."""
    row = label_summary(df, target)
    cells = row.select(
        "total", F.inline(F.array(*(F.struct(F.lit(v).alias("label"), F.col(f"label_{v}").alias("n")) for v in LABELS)))
    )
    percent = F.when(F.col("total") > 0, F.col("n") / F.col("total") * 100).otherwise(0.0)
    return cells.select("label", "n", percent.alias("percent"))


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, n); noise counts as a cluster."""
    return df.groupBy(cluster).agg(F.count("*").alias("n"))
