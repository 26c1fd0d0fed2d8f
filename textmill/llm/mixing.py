"""Mixing sources to target weights by systematic sampling.

A source's target is its share of all words by weight, at most ``ceiling`` times what it has; the excess
goes to the others by weight until none is above. Every document of a source expects target / size
copies. The documents of a source stand in a row by size; the running sum of the expected copies, moved
by one random offset, emits a document once for each integer boundary that it crosses. The order by size
keeps the words taken within about one document of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import ranked, table
from textmill.llm.registry import query
from textmill.sources.scratch import checkpoint

WEIGHTS = (1, 2, 3)
CEILING = 3
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str):
    """Number of words, whatever separates them being ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """``sources(absent, source, source_size)`` with weight and target (double).

    All uncapped sources share one level, words for a unit of weight. A round caps the sources above
    their ceiling and takes the level of the rest; only that one number reaches the driver. The level
    only rises, so the rounds end when no further source is capped.
    """
    place = F.col("place") - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = checkpoint(ranked(sources, [], ["absent", "source"], "place").withColumn("weight", weight).drop("place"))
    limit = F.col("source_size") * ceiling
    level = 0.0
    capped = -1
    while True:
        over = F.col("weight") * F.lit(level) >= limit
        row = weighed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, limit)).alias("capped"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if not row["weight"] or row["n"] == capped:
            break
        capped = row["n"]
        level = ((row["all"] or 0) - (row["capped"] or 0)) / row["weight"]
    target = F.when(F.col("weight") * F.lit(level) >= limit, limit.cast("double")).otherwise(F.col("weight") * F.lit(level))
    return weighed.withColumn("target", target)


def systematic_copies(sized: DataFrame, weights=WEIGHTS, ceiling=CEILING, seed=SEED) -> DataFrame:
    """``sized(row, source, size, tie)`` to (row, size, source_size, target, copies), all rows.

    ``row`` is a struct that travels whole, so its columns may have any names. A null source is a source
    of its own that comes last. Documents without words get copies like all others but take no words.
    Ties in size are settled by ``tie``; rows equal in source, size and tie may swap their copies. A
    source without words has target 0 and no copies. An empty table gives an empty result.
    """
    rows = sized.select(
        "row",
        F.col("source").isNull().alias("absent"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        "size",
        "tie",
    )
    placed = checkpoint(ranked(rows, ["absent", "source"], ["size", "tie"], "place"))
    totals = placed.groupBy("absent", "source").agg(F.sum("size").alias("source_size"))
    goal = checkpoint(targets(totals, weights, ceiling))
    # one random offset for each source, a function of the seed and its name
    name = F.concat(F.lit(f"{seed}|"), F.col("absent").cast("int").cast("string"), F.lit("|"), F.col("source"))
    offset = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / float(2**32)
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    crossed = F.floor(F.col("place") * rate + offset) - F.floor((F.col("place") - 1) * rate + offset)
    # a hot source is on the large side of this join only, whose partitions Spark splits
    return placed.join(goal, ["absent", "source"]).select(
        "row", "size", "source_size", "target", F.least(crossed, F.lit(ceiling)).cast("long").alias("copies")
    )


def mix(documents: DataFrame, source: str = "source", text: str = "text", tie: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix: each row as often as it was taken, with the columns it had.

    A null text has size 0. The cases of ``systematic_copies`` hold.
    """
    sized = documents.select(
        F.struct(*[f"`{c}`" for c in documents.columns]).alias("row"),
        F.col(f"`{source}`").alias("source"),
        n_words(f"`{text}`").alias("size"),
        F.col(f"`{tie}`").alias("tie"),
    )
    taken = systematic_copies(sized, **options).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


_SQL = r"""
    WITH RECURSIVE sized AS (
      SELECT doc_id, source IS NULL AS absent, coalesce(source, '') AS source,
        CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
      FROM documents),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY absent, source ORDER BY size, doc_id) AS place FROM sized),
    sources AS (
      SELECT absent, source, CAST(sum(size) AS BIGINT) AS source_size,
        [1, 2, 3][CAST((row_number() OVER (ORDER BY absent, source) - 1) % 3 + 1 AS INT)] AS weight
      FROM sized GROUP BY absent, source),
    -- the level that no further source is above: the least fixed point, found by raising it
    levels AS (
      SELECT 0 AS round, CAST(0 AS DOUBLE) AS level, -1 AS capped
      UNION ALL
      SELECT round + 1, step.level, step.n FROM (
        SELECT l.round, l.capped AS old, count(*) FILTER (WHERE weight * l.level >= 3 * source_size) AS n,
          (CAST(sum(source_size) AS DOUBLE) - coalesce(sum(3 * source_size) FILTER (WHERE weight * l.level >= 3 * source_size), 0))
            / nullif(sum(weight) FILTER (WHERE weight * l.level < 3 * source_size), 0) AS level
        FROM levels l, sources GROUP BY l.round, l.level, l.capped) AS step
      WHERE step.level IS NOT NULL AND step.n <> step.old),
    final AS (SELECT level FROM levels ORDER BY round DESC LIMIT 1),
    goals AS (
      SELECT absent, source, source_size,
        CASE WHEN weight * level >= 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE weight * level END AS target,
        CAST('0x' || substr(md5('mix|' || CAST(CAST(absent AS INT) AS VARCHAR) || '|' || source), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS start
      FROM sources, final),
    rated AS (
      SELECT p.*, source_size, target, start, coalesce(target / nullif(source_size, 0), 0) AS rate
      FROM placed p JOIN goals USING (absent, source))
    SELECT doc_id, size, source_size, target,
      size * least(3, CAST(floor(place * rate + start) - floor((place - 1) * rate + start) AS BIGINT)) AS taken
    FROM rated"""


@query("op10_mix_sources", _SQL)
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(F.struct("doc_id").alias("row"), "source", n_words("text").alias("size"), F.col("doc_id").alias("tie"))
    return systematic_copies(sized).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
