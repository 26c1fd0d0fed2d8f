"""Splitting, nearest neighbours, Naive Bayes and decision tree as model tables and scoring joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.operators.blocks import Block, in_order, meet_in_blocks, nearest_rows
from textmill.operators.features import fit_vectoriser, vectorise
from textmill.operators.grams import class_tokens, row_tokens
from textmill.operators.similarity import row_sets, token_frequencies
from textmill.operators.skew import lookup_join
from textmill.sources.scratch import checkpoint, discard

UNLIMITED_DEPTH = 30


# --- split ------------------------------------------------------------------------------------


def stratified_split(
    df: DataFrame, target: str = "target", test_size: float = 0.2, seed: int = 42, row_idx: str = "row_idx"
) -> DataFrame:
    """Add the boolean ``is_validation``: per class, the round(n * test_size) rows of lowest hash.

    The cut is found by counting: rows per (class, hash bucket) locate the bucket in which the wanted
    rank falls, and only the rows of that one bucket per class are ranked. One cut per class comes
    back as a literal, so the split itself is a filter expression: the data is not shuffled, whatever
    the share of a class.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_idx).cast("string")))
    bucket = F.conv(F.substring(digest, 1, 5), 16, 10).cast("int")
    hashed = df.select(F.col(target).alias("c"), digest.alias("h"), bucket.alias("b"), F.col(row_idx).alias("i"))

    per_bucket = hashed.groupBy("c", "b").agg(F.count("*").alias("n"))
    by_bucket, whole_class = Window.partitionBy("c").orderBy("b"), Window.partitionBy("c")
    running = per_bucket.select(
        "c", "b", "n",
        F.sum("n").over(by_bucket).alias("upto"),
        F.round(F.sum("n").over(whole_class) * F.lit(test_size)).cast("long").alias("wanted"),
    )
    edge = running.filter("upto >= wanted AND upto - n < wanted")
    edges = {r["c"]: (r["b"], r["wanted"] - r["upto"] + r["n"]) for r in edge.collect()}
    if not edges:
        return df.withColumn("is_validation", F.lit(False))

    pick = lambda values: F.create_map(*(F.lit(v) for pair in values.items() for v in pair))[F.col("c")]
    in_order = Window.partitionBy("c").orderBy("h", "i")
    bordering = hashed.filter(F.col("b") == pick({c: b for c, (b, _) in edges.items()}))
    last = bordering.withColumn("r", F.row_number().over(in_order)).filter(
        F.col("r") == pick({c: take for c, (_, take) in edges.items()})
    )
    chosen = F.lit(False)
    for c, h, i in last.select("c", "h", "i").collect():
        low = (digest < h) | ((digest == h) & (F.col(row_idx) <= i))
        chosen = F.when(F.col(target) == c, low).otherwise(chosen)
    return df.withColumn("is_validation", chosen)


def check_split(df: DataFrame, target: str = "target", test_size: float = 0.2) -> None:
    """Raise when a class has a single row or the validation part cannot hold every class."""
    per_class = df.groupBy(target).agg(F.count("*").alias("n"))
    least, classes, rows = per_class.agg(F.min("n"), F.count("*"), F.sum("n")).first()
    if rows is None:
        raise ValueError("no rows to train on")
    if least < 2:
        raise ValueError("the least populated class has only 1 row")
    if -(-rows * test_size // 1) < classes:
        raise ValueError("the validation part is smaller than the number of classes")


# --- Naive Bayes ------------------------------------------------------------------------------


@dataclass(frozen=True)
class NaiveBayesModel:
    """Tables: tokens(token, target, n), classes(target, rows, total, log_prior, vocabulary).

    A fitted model has its tokens by row, too: cells(token, n_0, n_1, ...), with counts by the classes in ``labels``.
    """

    tokens: DataFrame
    classes: DataFrame
    ngram: str = "unigram"
    feature_rep: str = "count"
    cells: DataFrame | None = None
    labels: tuple = ()


def fit_naive_bayes(
    df: DataFrame, text: str, target: str = "target", ngram: str = "unigram", feature_rep: str = "count"
) -> NaiveBayesModel:
    """Counts per (token, class) and per class. The smoothing term is added when scoring.

    The classes are a handful and become columns of one aggregate over tokens, so tokens are shuffled once. Their counts are
    written, a row for each token, since every later table and every scoring run reads them.
    """
    kind = df.schema[target].dataType
    values = tuple(r[0] for r in df.select(target).distinct().collect())
    labels = [F.lit(v).cast(kind) for v in values]
    # counts are added up in tasks before; more partial sums would save little
    found = class_tokens(df, text, target, ngram, feature_rep == "binary").repartition("token").groupBy("token")
    in_class = lambda c: F.coalesce(F.sum(F.when(F.col("target").eqNullSafe(c), F.col("n"))), F.lit(0))
    counted = found.agg(F.lit(0).alias("none"), *(in_class(c).alias(f"n_{i}") for i, c in enumerate(labels)))
    cells = checkpoint(counted.drop("none"))
    per_class = F.array(*(F.struct(c.alias("target"), F.col(f"n_{i}").alias("n")) for i, c in enumerate(labels)))
    shape = f"array<struct<target:{kind.simpleString()},n:bigint>>"
    tokens = cells.select("token", F.inline(per_class.cast(shape))).filter("n > 0")
    sums = tokens.groupBy("target").agg(F.sum("n").alias("total"))
    vocabulary = cells.count()
    rows = df.groupBy(F.col(target).alias("target")).agg(F.count("*").alias("rows"))
    classes = checkpoint(rows.join(sums, "target", "left"))
    all_rows = classes.agg(F.sum("rows")).first()[0]
    classes = classes.select(
        "target",
        "rows",
        F.coalesce("total", F.lit(0)).alias("total"),
        F.log(F.col("rows") / all_rows).alias("log_prior"),
        F.lit(vocabulary).cast("long").alias("vocabulary"),
    )
    return NaiveBayesModel(tokens, classes, ngram, feature_rep, cells, values)


def _class_counts(model: NaiveBayesModel, labels: Sequence) -> DataFrame:
    """(token, seen_0, seen_1, ...): how often a token occurs in each class of ``labels``."""
    if model.cells is not None:
        held = [F.col(f"n_{model.labels.index(c)}") if c in model.labels else F.lit(0).cast("bigint") for c in labels]
        return model.cells.select("token", *(n.alias(f"seen_{i}") for i, n in enumerate(held)))
    seen = lambda c: F.coalesce(F.sum(F.when(F.col("target") == c, F.col("n"))), F.lit(0))
    return model.tokens.groupBy("token").agg(F.lit(0).alias("none"), *(seen(c).alias(f"seen_{i}") for i, c in enumerate(labels))).drop("none")


def _log_likelihood(seen: Column, total: int, vocabulary: int) -> Column:
    return F.log((seen + 1) / F.lit(float(total + vocabulary)))


def naive_bayes_likelihood(model: NaiveBayesModel) -> DataFrame:
    """(token, target, log_likelihood) for every vocabulary token and class."""
    classes = model.classes.collect()
    cells = [
        F.struct(
            F.lit(c["target"]).alias("target"),
            _log_likelihood(F.col(f"seen_{i}"), c["total"], c["vocabulary"]).alias("log_likelihood"),
        )
        for i, c in enumerate(classes)
    ]
    return _class_counts(model, [c["target"] for c in classes]).select("token", F.inline(F.array(*cells)))


def naive_bayes_scores(model: NaiveBayesModel, df: DataFrame, text: str, row_idx: str = "row_idx") -> DataFrame:
    """(row_idx, scores): per class a struct (score, target), one row per text; unseen tokens are left out.

    Tokens are counted in the task, then looked up. The classes are a handful of literals, so all
    their sums come from one aggregate. A text's prior travels as one more token that no text can hold
    (tokens have no white space), so texts without a known token are decided by the priors alone.
    """
    classes = sorted(model.classes.collect(), key=lambda c: c["target"])
    found = row_tokens(df, text, model.ngram, model.feature_rep == "binary", row_idx)
    tokens = found.unionByName(df.select(row_idx, F.lit(" ").alias("token"), F.lit(1).cast("bigint").alias("times")))
    counts = _class_counts(model, [c["target"] for c in classes])
    known = lookup_join(tokens, counts.withColumn("known", F.lit(True)), "token", "left")
    # counts, which pack well, go to the rows; their logs are taken there
    is_prior = F.col("token") == " "
    times = F.when(is_prior, 0).otherwise(F.col("times")).alias("times")  # 0 marks the prior
    seen = [f"seen_{i}" for i in range(len(classes))]
    sent = known.filter(is_prior | F.col("known")).select(row_idx, times, *seen).repartition(row_idx)
    parts = sent.select(
        row_idx,
        *(
            F.when(F.col("times") == 0, F.lit(c["log_prior"]))
            .otherwise(F.col("times") * _log_likelihood(F.col(f"seen_{i}"), c["total"], c["vocabulary"]))
            .alias(f"part_{i}")
            for i, c in enumerate(classes)
        ),
    )
    scores = F.array(
        *(
            F.struct(F.round(F.sum(f"part_{i}"), 6).alias("score"), F.lit(c["target"]).alias("target"))
            for i, c in enumerate(classes)
        )
    )
    return parts.groupBy(row_idx).agg(scores.alias("scores"))


def predict_naive_bayes(model: NaiveBayesModel, df: DataFrame, text: str, row_idx: str = "row_idx") -> DataFrame:
    """(row_idx, predicted, score): the best class; the smaller label wins a tie."""
    negated = lambda s: F.struct(s["score"], (-s["target"]).alias("negated"))
    best = F.array_max(F.transform("scores", negated)).alias("best")
    return naive_bayes_scores(model, df, text, row_idx).select(row_idx, best).select(
        row_idx, (-F.col("best.negated")).alias("predicted"), F.col("best.score").alias("score")
    )


# --- nearest neighbours -----------------------------------------------------------------------


@dataclass(frozen=True)
class NeighbourModel:
    """Tables: sets(set, set_key, size, ids, target, neighbour), members(set_key, target, neighbour) and
    frequencies(tok, n, id). Words are compared by their numbers; target and neighbour of a set are those of its first row."""

    sets: DataFrame
    members: DataFrame
    frequencies: DataFrame
    k: int = 5


def fit_neighbours(
    df: DataFrame, text: str, target: str = "target", k: int = 5, row_idx: str = "row_idx"
) -> NeighbourModel:
    """Collapse equal word sets and number their words.

    Only the first k rows of each (set, class) can be among the k nearest of anything, since all of
    them are equally far from it and the row number settles ties.
    """
    rows = row_sets(df.withColumnRenamed(target, "target"), text, row_idx, "target")
    in_class = Window.partitionBy("set_key", "target").orderBy("neighbour")
    members = checkpoint(
        rows.select("set_key", "target", F.col(row_idx).alias("neighbour"))
        .withColumn("r", F.row_number().over(in_class))
        .filter(F.col("r") <= k)
        .drop("r")
    )
    distinct = rows.groupBy("set_key").agg(F.min(row_idx).alias("gid"), F.first("words").alias("words")).filter("gid IS NOT NULL")
    sets = checkpoint(distinct.select("set_key", "words", F.size("words").alias("size"), F.monotonically_increasing_id().alias("set")))
    frequencies = checkpoint(in_order(token_frequencies(sets), "n", "tok"))
    first = members.groupBy("set_key").agg(F.min(F.struct("target", "neighbour")).alias("first"))
    numbered = sets.drop("words").join(_word_numbers(sets, "set", frequencies), "set").join(first, "set_key")
    numbered = checkpoint(numbered.select("set", "set_key", "size", "ids", "first.target", "first.neighbour"))
    discard(sets)
    return NeighbourModel(numbered, members, frequencies, k)


def _word_numbers(sets: DataFrame, key: str, frequencies: DataFrame) -> DataFrame:
    """(key, ids): the numbers of the words of each set that ``frequencies`` knows; sets without one are left out."""
    words_ = sets.select(key, F.explode("words").alias("tok"))
    return lookup_join(words_, frequencies.select("tok", "id"), "tok").groupBy(key).agg(F.collect_list("id").alias("ids"))


def _nearest_sets(model: NeighbourModel, queries: DataFrame) -> DataFrame:
    """(q, set, distance): the sets that hold the k nearest rows of each query (q, size, ids), among those with a common word.

    Blocks of queries meet blocks of sets, one pair of blocks a group. A task counts common words and sends the k nearest
    sets of a query, in the order of their first rows where they tie: all rows of any other set lie behind those k rows.
    """
    k = model.k

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        asked, held = (table.filter(pc.equal(table["side"], s)) for s in (0, 1))
        del table
        held = held.take(pc.sort_indices(held, [("target", "ascending"), ("neighbour", "ascending")], null_placement="at_start"))
        a, b = Block.of(asked, "ids"), Block.of(held, "ids")
        sets, queries_ = b.column("id"), a.column("id")
        for i, j, distance in nearest_rows(a, b, a.column("size"), b.column("size"), k):
            yield pa.RecordBatch.from_arrays([pa.array(queries_[i]), pa.array(sets[j]), pa.array(distance)], names=["q", "set", "distance"])

    side = lambda df, id_, *order: df.select(F.col(id_).cast("long").alias("id"), "size", "ids", *order)
    kinds = {f.name: f.dataType for f in model.sets.schema.fields}
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in ("target", "neighbour")]
    found = meet_in_blocks(
        side(queries, "q", *none), side(model.sets, "set", "target", "neighbour"), "ids", work, "q long, set long, distance double"
    )
    order = model.sets.select("set", "set_key", "target", "neighbour")
    nearest_first = Window.partitionBy("q").orderBy("distance", "target", "neighbour")
    best = lookup_join(found, order, "set").withColumn("r", F.row_number().over(nearest_first))
    return best.filter(F.col("r") <= k).select("q", "set", "set_key", "distance")


def neighbours_of_sets(model: NeighbourModel, query_sets: DataFrame) -> DataFrame:
    """(q, neighbour, target, distance, rank): the exact k nearest rows of each query set (q, size, words).

    Queries with fewer than k overlapping rows are filled up with the first rows of the base, which all lie at distance 1.
    """
    k = model.k
    queries = checkpoint(query_sets.select("q", "size", "words", F.monotonically_increasing_id().alias("number")))
    ids = _word_numbers(queries, "number", model.frequencies)
    asked = queries.select(F.col("number").alias("q"), "size").join(ids.withColumnRenamed("number", "q"), "q")
    near = checkpoint(lookup_join(_nearest_sets(model, asked).withColumnRenamed("q", "number"), queries.select("number", "q"), "number").drop("number"))
    best = Window.partitionBy("q").orderBy("distance", "target", "neighbour")
    overlapping = (
        near.join(model.members, "set_key")
        .select("q", "neighbour", "target", "distance")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
    )
    # at most k of the first 2k rows of the base can be overlapping rows already
    filler = (
        model.members.orderBy("target", "neighbour").limit(2 * k)
        .agg(F.collect_list(F.struct(F.lit(1.0).alias("distance"), "target", "neighbour"))).scalar()
    )
    shape = "array<struct<distance:double,target:int,neighbour:bigint>>"
    found = F.collect_list(F.struct("distance", "target", "neighbour"))
    per_query = queries.select("q").join(overlapping.groupBy("q").agg(found.alias("found")), "q", "left")
    present = F.coalesce(F.col("found").cast(shape), F.array().cast(shape))
    per_query = per_query.select("q", present.alias("present"), filler.cast(shape).alias("filler"))
    present = F.col("present")
    taken = F.transform(present, lambda x: x["neighbour"])
    extra = F.filter("filler", lambda x: ~F.array_contains(taken, x["neighbour"]))
    ordered = F.slice(F.array_sort(F.concat(present, extra)), 1, k)
    return per_query.select("q", F.posexplode(ordered).alias("p", "x")).select(
        "q", "x.neighbour", "x.target", "x.distance", (F.col("p") + 1).alias("rank")
    )


def _query_sets(df: DataFrame, text: str, row_idx: str) -> tuple[DataFrame, DataFrame]:
    rows = row_sets(df, text, row_idx)
    sets = rows.groupBy("set_key").agg(F.first("words").alias("words")).select(
        F.col("set_key").alias("q"), F.size("words").alias("size"), "words"
    )
    return rows.select(row_idx, F.col("set_key").alias("q")), sets


def nearest_neighbours(model: NeighbourModel, df: DataFrame, text: str, row_idx: str = "row_idx") -> DataFrame:
    """(row_idx, rank, neighbour, target, distance), ordered by distance, then label, then row."""
    rows, sets = _query_sets(df, text, row_idx)
    found = neighbours_of_sets(model, sets).groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("rank", "neighbour", "target", "distance"))).alias("found")
    )
    return lookup_join(rows, found, "q").select(row_idx, F.inline("found"))


def predict_neighbours(model: NeighbourModel, df: DataFrame, text: str, row_idx: str = "row_idx") -> DataFrame:
    """(row_idx, predicted, votes): majority of the k nearest; the smaller label wins a tie."""
    rows, sets = _query_sets(df, text, row_idx)
    votes = neighbours_of_sets(model, sets).groupBy("q", "target").agg(F.count("*").alias("votes"))
    best = F.max(F.struct("votes", (-F.col("target")).alias("negated"))).alias("best")
    chosen = votes.groupBy("q").agg(best).select(
        "q", (-F.col("best.negated")).alias("predicted"), F.col("best.votes").alias("votes")
    )
    return lookup_join(rows, chosen, "q").select(row_idx, "predicted", "votes")


# --- decision tree ----------------------------------------------------------------------------


@dataclass(frozen=True)
class TreeModel:
    vectoriser: PipelineModel
    tree: DecisionTreeClassificationModel


def fit_tree(
    df: DataFrame, text: str, target: str = "target", max_depth: int | None = None, seed: int = 42
) -> TreeModel:
    """Decision tree on TF-IDF vectors; no depth means the deepest tree MLlib grows."""
    prepared = df.withColumn("__text", F.coalesce(text, F.lit(""))).withColumn("__label", F.col(target).cast("double"))
    vectoriser = fit_vectoriser(prepared, "__text")
    depth = UNLIMITED_DEPTH if max_depth is None else max_depth
    tree = DecisionTreeClassifier(
        featuresCol="features", labelCol="__label", predictionCol="__prediction", maxDepth=depth, seed=seed
    )
    # MLlib reads the vectors several times; texts are not kept with them
    kept = vectorise(vectoriser, prepared).select("features", "__label").persist(StorageLevel.DISK_ONLY)
    fitted = tree.fit(kept)
    kept.unpersist()
    return TreeModel(vectoriser, fitted)


def predict_tree(model: TreeModel, df: DataFrame, text: str, row_idx: str = "row_idx") -> DataFrame:
    prepared = df.select(row_idx, F.coalesce(text, F.lit("")).alias("__text"))
    scored = model.tree.transform(vectorise(model.vectoriser, prepared))
    return scored.select(row_idx, F.col("__prediction").cast("int").alias("predicted"))


# --- storing models ---------------------------------------------------------------------------


@dataclass(frozen=True)
class KeywordModel:
    positives: Sequence[str]
    negatives: Sequence[str]


def save_model(model, path: str) -> None:
    """Write a model's tables (or MLlib stages) under one folder."""
    if isinstance(model, TreeModel):
        model.vectoriser.write().overwrite().save(f"{path}/vectoriser")
        model.tree.write().overwrite().save(f"{path}/tree")
        return
    spark = SparkSession.active()
    if isinstance(model, KeywordModel):
        rows = [(w, True) for w in model.positives] + [(w, False) for w in model.negatives]
        tables = {"keywords": spark.createDataFrame(rows, "word string, positive boolean")}
        options = {"kind": "keywords", "ngram": "", "feature_rep": "", "k": 0}
    elif isinstance(model, NaiveBayesModel):
        tables = {"tokens": model.tokens, "classes": model.classes}
        options = {"kind": "naive_bayes", "ngram": model.ngram, "feature_rep": model.feature_rep, "k": 0}
    else:
        tables = {t: getattr(model, t) for t in ("sets", "members", "frequencies")}
        options = {"kind": "knn", "ngram": "", "feature_rep": "", "k": model.k}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([options]).write.mode("overwrite").parquet(f"{path}/options")


def load_model(spark: SparkSession, path: str, kind: str = "tables"):
    """Read a stored model; ``kind="tree"`` for a decision tree."""
    if kind == "tree":
        return TreeModel(
            PipelineModel.load(f"{path}/vectoriser"), DecisionTreeClassificationModel.load(f"{path}/tree")
        )
    options = spark.read.parquet(f"{path}/options").first()
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    if options["kind"] == "keywords":
        lists = {True: [], False: []}
        for r in table("keywords").orderBy("word").collect():
            lists[r["positive"]].append(r["word"])
        return KeywordModel(tuple(lists[True]), tuple(lists[False]))
    if options["kind"] == "naive_bayes":
        return NaiveBayesModel(table("tokens"), table("classes"), options["ngram"], options["feature_rep"])
    return NeighbourModel(table("sets"), table("members"), table("frequencies"), options["k"])
