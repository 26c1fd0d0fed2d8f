"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

A text's features are its shingles of five words, weighted by how often it holds them times an inverse
document frequency of 1 + IDF_SHARE * log(N / df) / log(N). A passage that many documents share counts
less, but little enough for copies in a group of thousands to stay as similar as in a pair. Each sampling
function picks one (shingle, level) of a text; two texts agree with the probability of their weighted
Jaccard similarity. Samples are banded; texts that share a
band are candidates and are verified on their whole shingles. Classes are the connected components of the
verified links.

Copies are one node from the start. In a band's bucket all nodes are compared with its most central one: the
node that meets the most others over all its bands, which is the best guess at what a group of edited copies comes
from. What this leaves in different classes is searched exactly, without pairs of all: of two sets as similar
as asked for, the rarest shingles that make up more than the difference allows must meet. A shingle is indexed
under the range of the partner's weight, and only while what follows it in the set's order still weighs enough
to be shared with a partner of that weight; keys whose nodes are all of one class are left out. Links within a class
are not needed and not looked for.

Document frequencies are counted over all documents in a hashed table of fixed size, which is what
reaches every task. Shingles much rarer than one in 2^DF_BITS look alike in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm.chunks import giving_back, pieces, ragged
from textmill.llm.common import partitions, table
from textmill.llm.registry import query
from textmill.llm.words import StretchHashes, gram_hashes, mix, text_words
from textmill.operators.components import connected_components
from textmill.operators.skew import ROWS_PER_TASK, salted_pairs
from textmill.sources.scratch import checkpoint, discard

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 9, 3
IDF_SHARE = 0.25
DF_BITS = 20
DF_CHUNKS = 16  # rows in which the table of frequencies travels
WEIGHT_STEP = 1.03  # ratio of neighbouring ranges of weights in the index of shingles
SHINGLES_AT_A_TIME = 1 << 17
TEXT_AT_A_TIME = 1 << 20  # bytes; a longer text is worked on by itself
PAIRS_AT_A_TIME = 256
SLACK = 1e-6


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each text in a row, times they occur, number of them by text).

    A text of fewer than five words has one shingle, of all its words; one without words has none.
    """
    words, places, edges = text_words(column)
    whole = gram_hashes(words, ())[0]
    sizes = np.diff(edges)
    counts = np.where(sizes > 0, np.maximum(sizes - SHINGLE + 1, 1), 0)
    starts = ragged(np.arange(len(places) + 1), edges[:-1], counts)
    owner = np.repeat(np.arange(len(sizes)), counts)
    hashes = StretchHashes(whole[places])(starts, np.minimum(starts + SHINGLE, edges[owner + 1]))
    # repeats within a text are few: find them by sorting, and put only them together
    own = mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(own)
    repeated = ordered[1:][ordered[1:] == ordered[:-1]]
    times = np.ones(len(hashes), np.int64)
    if len(repeated):
        at = np.flatnonzero(np.isin(own, repeated))
        _, first, n = np.unique(own[at], return_index=True, return_counts=True)
        times[at] = 0
        times[at[first]] = n
        kept = np.flatnonzero(times)
        hashes, times, owner = hashes[kept], times[kept], owner[kept]
    return hashes, times, np.bincount(owner, minlength=len(sizes))


def _df_slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - DF_BITS)).astype(np.int64)


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """1 + IDF_SHARE * log(N / df) / log(N) for each slot of the hashed table, over all rows of ``texts(text)``.

    Tasks count into the table, some tasks add the tables of all others up, and one task for each part
    of the table finishes it; only the finished table, of fixed size, reaches the driver.
    """
    size = (1 << DF_BITS) // DF_CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in pieces(batches, "text", TEXT_AT_A_TIME):
            hashes, _, counts = shingles(batch.column(0))
            seen += np.bincount(_df_slot(hashes), minlength=1 << DF_BITS)
            n += int((counts > 0).sum())
        yield table_of({k: part for k, part in enumerate(seen.reshape(DF_CHUNKS, size))} | {-1: np.array([n])})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(part, np.int64)
                total[k] = total[k] + part if k in total else part
        yield table_of(total)

    def table_of(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        parts = [x.tobytes() for x in total.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "part"])

    schema = "chunk int, part binary"
    some = max(1, partitions(texts.sparkSession) // 8)
    counted = texts.select("text").mapInArrow(giving_back(count), schema).repartition(some).mapInArrow(add, schema)
    rows = counted.repartition(DF_CHUNKS, "chunk").mapInArrow(add, schema).collect()
    found = {r["chunk"]: np.frombuffer(r["part"], np.int64) for r in rows}
    n = int(found.get(-1, np.zeros(1))[0])
    if n < 2:
        return np.ones(1 << DF_BITS, np.float32)
    df = np.concatenate([found[k] for k in range(DF_CHUNKS)])
    rare = np.log(np.maximum(n / np.maximum(df, 1), 1)) / np.log(n)
    return (1 + IDF_SHARE * rare).astype(np.float32)


def samples(hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray, functions: int = BANDS * ROWS) -> np.ndarray:
    """(texts, functions): what each sampling function picks of each text that has shingles.

    For a shingle of weight w, with r and c from Gamma(2, 1) and b from [0, 1) drawn by its hash:
    t = floor(log w / r + b), and the shingle with the least c / exp(r (t - b + 1)) is picked with its t.
    """
    if not len(hashes):
        return np.empty((0, functions), np.uint64)
    ends = np.cumsum(counts)
    starts = ends - counts
    log_w = np.log(weights).astype(np.float32)
    out = np.empty((len(counts), functions), np.uint64)
    unit = np.float32(2.0**-32)
    half = lambda x: ((x >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * unit
    low = lambda x: ((x & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) * unit
    for k in range(functions):
        a = mix(hashes ^ np.uint64((k + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        b = mix(a + np.uint64(0xA0761D6478BD642F))
        beta = half(mix(b ^ np.uint64(0xE7037ED1A0B428DB)))
        r = -np.log(half(a) * low(a)) + np.float32(1e-6)
        c = -np.log(half(b) * low(b)) + np.float32(1e-30)
        t = np.floor(log_w / r + beta)
        worth = np.log(c) - r * (t - beta + 1)
        least = np.minimum.reduceat(worth, starts)
        at = np.flatnonzero(worth == np.repeat(least, counts))
        at = at[np.searchsorted(at, starts)]  # the first of each text
        out[:, k] = mix(hashes[at] + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
    return out


def digests(hashes: np.ndarray, times: np.ndarray, counts: np.ndarray) -> list[str | None]:
    """128 bits of the shingles of each text with their numbers; none for a text without shingles."""
    out: list[str | None] = [None] * len(counts)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        summed = [np.add.reduceat(mix(hashes ^ np.uint64(salt)) * times.astype(np.uint64), starts) for salt in (0x1234567, 0x89ABCDEF01)]
        for i, a, b in zip(some.tolist(), *(x.tolist() for x in summed), strict=True):
            out[i] = f"{a:016x}{b:016x}"
    return out


def _sign(idf):
    """Per document its node (a digest of its weighted shingles), total weight and a key for each band."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight_of = idf.value
        for batch in pieces(batches, "text", TEXT_AT_A_TIME):
            hashes, times, counts = shingles(batch.column("text"))
            weights = times * weight_of[_df_slot(hashes)]
            some = np.flatnonzero(counts)
            totals, bands = np.zeros(len(counts)), [None] * len(counts)
            if len(some):
                totals[some] = np.add.reduceat(weights.astype(np.float64), (np.cumsum(counts) - counts)[some])
                for i, keys in zip(some.tolist(), _band_keys(_in_parts(hashes, weights, counts[some])).tolist(), strict=True):
                    bands[i] = keys
            nodes = digests(hashes, times, counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(nodes, pa.string()), pa.array(totals), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "node", "weight", "bands"],
            )

    return work


def _in_parts(hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``samples`` over runs of texts that fit the processor's cache."""
    ends = np.cumsum(counts)
    out, at = [], 0
    while at < len(counts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + SHINGLES_AT_A_TIME, side="right")))
        part = slice(int(done), int(ends[to - 1]))
        out.append(samples(hashes[part], weights[part], counts[at:to]))
        at = to
    return np.concatenate(out)


def _band_keys(picked: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(picked), BANDS), np.uint64)
    for k in range(picked.shape[1]):
        keys[:, k // ROWS] = mix(keys[:, k // ROWS] * np.uint64(0x9FB21C651E98DF25) + picked[:, k] + np.uint64(k // ROWS + 1))
    return keys.view(np.int64)


def _whole_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hashes in ascending order, times) of ``(node, text)``, for the texts that are their node's."""
    for batch in pieces(batches, "text", TEXT_AT_A_TIME):
        hashes, times, counts = shingles(batch.column("text"))
        own_node = pa.array([a == b for a, b in zip(digests(hashes, times, counts), batch.column("node").to_pylist(), strict=True)], pa.bool_())
        sets, numbers, at = [], [], 0
        for n in counts.tolist():
            own = slice(at, at + n)
            order = np.argsort(hashes[own])
            sets.append(hashes[own][order].tobytes())
            numbers.append(times[own][order].astype(np.uint32).tobytes() if (times[own] > 1).any() else b"")
            at += n
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(sets, pa.binary()), pa.array(numbers, pa.binary())], names=["node", "hashes", "times"]
        ).filter(own_node)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over the sum of the greater ones; (distinct hashes, weights) of each."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    return both / (float(a[1].sum()) + float(b[1].sum()) - both)


def _verify(idf, least: float):
    def weighted(hashes: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
        h = np.frombuffer(hashes, np.uint64)
        w = idf.value[_df_slot(h)].astype(np.float64)
        return h, w * np.frombuffer(times, np.uint32) if times else w

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS_AT_A_TIME):
                part = batch.slice(at, PAIRS_AT_A_TIME)
                columns = [part.column(c).to_pylist() for c in ("a_hashes", "a_times", "b_hashes", "b_times")]
                good = [weighted_jaccard(weighted(p, q), weighted(r, s)) >= least for p, q, r, s in zip(*columns, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return work


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id) for every row: the smallest doc_id of its class of near-duplicates.

    Words are what white space separates, in lower case. Texts without words (null and empty ones too)
    and rows with a null id are alone in their classes. Copies, repeated rows too, share a class; rows
    that share an id but not a text each have the class of their text. An empty table gives an empty
    result. No column but the two named is read.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    idf = spark.sparkContext.broadcast(inverse_frequencies(rows))
    signed = checkpoint(rows.mapInArrow(giving_back(_sign(idf)), "doc_id long, node string, weight double, bands array<long>"))
    named = signed.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = named.groupBy("node").agg(F.min("doc_id").alias("owner"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    bucketed = checkpoint(nodes.select("node", "owner", "weight", F.explode("bands").alias("key")))
    shared = bucketed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = checkpoint(bucketed.join(shared, "key"))
    discard(bucketed)
    # the whole shingles of the nodes that meet another one
    owners = members.select("node", "owner").distinct()
    texts = rows.join(owners.hint("shuffle_hash"), rows["doc_id"] == owners["owner"]).select("node", "text")
    # (an id that repeats may bring other texts than the node's; they are left out there)
    own = texts.mapInArrow(giving_back(_whole_shingles), "node string, hashes binary, times binary")
    whole = checkpoint(own.groupBy("node").agg(F.first("hashes").alias("hashes"), F.first("times").alias("times")))

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda c: whole.select(F.col("node").alias(c), F.col("hashes").alias(f"{c}_hashes"), F.col("times").alias(f"{c}_times"))
        joined = pairs.select("a", "b").distinct().join(side("b"), "b").join(side("a"), "a")
        return joined.mapInArrow(giving_back(_verify(idf, least)), "a string, b string")

    # a node's buckets are large where it keeps what its group shares
    central = members.groupBy("node").agg(F.sum("n").alias("met"))
    rank = F.struct("met", (-F.col("weight")).alias("lightest"), "node", "weight")
    heads = members.join(central, "node").groupBy("key").agg(F.max(rank).alias("head")).select("key", "head.*")
    heads = heads.select("key", F.col("node").alias("centre"), F.col("weight").alias("centre_weight"))
    first = members.join(heads, "key").filter(F.col("node") != F.col("centre")).filter(_alike("weight", "centre_weight", least))
    links = checkpoint(verified(first.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))))
    component = checkpoint(_components(links))
    # buckets of two nodes are done; of the others, those whose nodes are in several classes are searched
    placed = members.filter("n > 2").select("key", "node", "weight").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = checkpoint(placed)
    spread = placed.groupBy("key").agg(F.min("component").alias("main"), F.max("component").alias("last")).filter("main <> last")
    open_ = checkpoint(placed.join(spread.select("key"), "key").select("node", "component", "weight").distinct())
    side, prefixes = postings(open_, whole, idf, least)
    # what one node of each key joins needs no pairs any more
    some = _components(_renamed(checkpoint(verified(centre_pairs(side, least))), component))
    component = checkpoint(_followed(component, some))
    newer = side.join(some.select(F.col("node").alias("component"), F.col("component").alias("newer")), "component", "left")
    side = newer.withColumn("component", F.coalesce("newer", "component")).drop("newer")
    joined = _components(_renamed(checkpoint(verified(all_pairs(side, prefixes, least))), component))
    discard(members, whole, placed, open_, links)
    # a hot class is on the large side of these joins only, whose partitions Spark splits
    placed = signed.select("doc_id", "node").join(component, "node", "left").select("doc_id", F.coalesce("component", "node").alias("name"))
    placed = placed.join(joined.select(F.col("node").alias("name"), "component"), "name", "left")
    placed = checkpoint(placed.select("doc_id", F.coalesce("component", "name").alias("class")))
    discard(signed)
    least_id = placed.filter("doc_id IS NOT NULL AND class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return placed.join(least_id, "class", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")
    )


def _alike(a: str, b: str, least: float) -> Column:
    """A similarity is at most the ratio of the total weights."""
    return F.least(a, b) >= F.greatest(a, b) * (least - SLACK)


def postings(nodes: DataFrame, whole: DataFrame, idf, least: float) -> tuple[DataFrame, DataFrame]:
    """The index of shingles of ``nodes(node, component, weight)``: (node, component, weight, rest, key, place), and
    (node, prefix), short hashes of the shingles of each node that are indexed in their order; ``place`` counts in it.

    Each set's shingles are ordered by the number of nodes that hold them, rarest first. Two sets of weights w and v
    share at least least / (1 + least) * (w + v) if they are similar. They share nothing before the first
    shingle that both hold, so that much weighs what follows it in either set, itself included (``rest``): a shingle is
    indexed for partners of weight v only as long as that holds. Texts that have a passage in common but too much
    of their own around it never meet that way, however many they are.
    """
    share = least / (1 + least)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h = np.frombuffer(batch.column("hashes")[i].as_py(), np.uint64)
                w, times = idf.value[_df_slot(h)].astype(np.float64), batch.column("times")[i].as_py()
                w = w * np.frombuffer(times, np.uint32) if times else w
                name = pa.array([batch.column("node")[i].as_py()] * len(h), pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(h.view(np.int64)), pa.array(w)], names=["node", "shingle", "w"])

    held = whole.join(nodes.select("node"), "node", "left_semi").mapInArrow(giving_back(work), "node string, shingle long, w double")
    held = checkpoint(held)
    counts = held.groupBy("shingle").agg(F.count("*").alias("holders"))
    # summed from the most frequent shingle on
    order = Window.partitionBy("node").orderBy(F.desc("holders"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0)
    follows = held.join(counts, "shingle").withColumn("rest", F.sum("w").over(order)).filter("holders > 1").select("node", "shingle", "rest")
    # partners weigh from least times the own weight to what the rest still allows
    most = F.col("rest") / share - F.col("weight")
    range_of = lambda weight: F.floor(F.ln(weight) / F.lit(float(np.log(WEIGHT_STEP)))).cast("int")
    kept = follows.join(nodes, "node").filter(most >= F.col("weight") * (least - SLACK))
    kept = checkpoint(kept.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("rest"), "shingle"))))
    # 32 bits of a shingle are enough: a pair is lost by them once in some million pairs, far less often than by the bands
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("place", F.hash("shingle").alias("short")))), lambda x: x["short"])
    prefixes = checkpoint(kept.groupBy("node").agg(in_order.alias("prefix")))
    # a little more than allowed, as sums are rounded
    other = F.explode(F.sequence(range_of(F.col("weight") * (least - SLACK)), range_of(F.least(most, F.col("weight") / least) * (1 + SLACK))))
    side = kept.withColumn("own", range_of(F.col("weight"))).select("node", "component", "weight", "rest", "place", "shingle", "own", other.alias("other"))
    key = F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other")).alias("key")
    found = checkpoint(side.select("node", "component", "weight", "rest", "place", key))
    discard(held, kept)
    return found, prefixes


def _open_keys(side: DataFrame) -> DataFrame:
    """(key, n_left, n_right) of the keys whose nodes are in different components."""
    sizes = side.groupBy("key").agg(F.count("*").alias("n_left"), F.min("component").alias("main"), F.max("component").alias("last"))
    return sizes.filter("main <> last").select("key", "n_left", F.col("n_left").alias("n_right"))


def centre_pairs(side: DataFrame, least: float) -> DataFrame:
    """(a, b) of the lightest node of each key, which has the least of its own, and all others it may be similar to."""
    centre = side.join(_open_keys(side), "key", "left_semi").groupBy("key").agg(F.min(F.struct("weight", "node", "component", "rest")).alias("c"))
    met = side.join(centre, "key").filter((F.col("component") != F.col("c.component")) & _possible("weight", "rest", "c.weight", "c.rest", least))
    return met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def all_pairs(side: DataFrame, prefixes: DataFrame, least: float) -> DataFrame:
    """(a, b) of all nodes of different components that meet under some key and may be as similar as ``least``.

    Nodes that share several shingles are paired at the first one only: what rules a pair out there rules it out at all.
    """
    sizes = checkpoint(_open_keys(side))
    side = side.join(sizes.select("key"), "key", "left_semi").join(prefixes, "node")
    side = checkpoint(side.select("node", "component", "weight", "rest", "key", F.slice("prefix", F.lit(1), F.col("place") - 1).alias("earlier")))
    possible = (F.col("a.component") < F.col("b.component")) & _possible("a.weight", "a.rest", "b.weight", "b.rest", least)
    possible &= ~F.arrays_overlap("a.earlier", "b.earlier")
    # few keys or none are heavy; as a small table of its own they are sent to the rows
    heavy = checkpoint(sizes.filter(F.col("n_left") > ROWS_PER_TASK))
    pairs = salted_pairs(side, side, "key", heavy, possible)
    return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def _possible(a: str, a_rest: str, b: str, b_rest: str, least: float) -> Column:
    share = least / (1 + least) * (1 - SLACK)
    return (F.least(a_rest, b_rest) >= share * (F.col(a) + F.col(b))) & _alike(a, b, least)


def _followed(component: DataFrame, newer: DataFrame) -> DataFrame:
    """``component`` with the components of its components, and with the nodes that only ``newer`` has."""
    inner = newer.select(F.col("node").alias("component"), F.col("component").alias("newer"))
    moved = component.join(inner, "component", "left").select("node", F.coalesce("newer", "component").alias("component"))
    alone = newer.join(component.select("node"), "node", "left_anti")
    return moved.unionByName(alone.select("node", "component"))


def _renamed(links: DataFrame, component: DataFrame) -> DataFrame:
    """``links`` between the components of their nodes; a node without one is its own."""
    for c in ("a", "b"):
        links = links.join(component.select(F.col("node").alias(c), "component"), c, "left")
        links = links.withColumn(c, F.coalesce("component", c)).drop("component")
    return links.select("a", "b").distinct()


def _components(links: DataFrame) -> DataFrame:
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    return connected_components(ends, links)


def one_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` without the rows whose class holds a smaller id; rows that share an id go or stay together."""
    classes = near_duplicates(documents, doc_id, text)
    gone = classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    return documents.join(gone.hint("shuffle_hash"), documents[f"`{doc_id}`"] == F.col("__gone"), "left_anti")


@query("op8_minhash_classes")
def op8_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
