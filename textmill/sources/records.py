"""Delimited files by records: line breaks inside quotes in any charset, without a task for a whole file.

Files are read by lines, so that they stay splittable. Whether a line starts inside quotes depends on all lines before
it. A line is therefore reduced to what it makes of either state (inside or outside), which a fold over its quotes
gives; most lines leave the state as it is. Lines are put together in their split, one row for each split is
put together over the file, and then each split knows how it starts. Records are cut inside the splits, in
one exchange that deals out whole splits; only the pieces on both sides of a split's edge are joined after it. What is
called a split here is a stretch of a bounded number of lines of a file's split, so that tasks hold little at a time.

A quote opens at the start of a field only, is doubled inside quotes, and is plain text elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.operators.skew import lookup_join
from textmill.sources.scratch import checkpoint

# Code points 0x80-0x9F that cp1252 defines, and the characters they stand for.
CP1252_BYTES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
CP1252_FROM = "".join(chr(b) for b in CP1252_BYTES)
CP1252_TO = bytes(CP1252_BYTES).decode("cp1252")
CP1252_UNDEFINED = "[\x81\x8d\x8f\x90\x9d]"
# states between the quotes of a line
FIELD, INSIDE, CLOSED, TEXT = 0, 1, 2, 3
SPLIT = ["file", "number", "block"]
STRETCH_BITS = 15  # lines of a stretch, as a power of two


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, block, id, line): all lines with their bytes as they are; ``id`` orders the lines of a split.

    Splits of files are cut into stretches of at most 2^15 lines, which count as splits from here on: ``block`` is the start
    of the file's split and what stretch of the task it is. No line is empty of bytes, so this stays below the next split's start.
    Only a byte order mark is taken from where lines of a file's first split start.
    """
    marked = (F.col("_metadata.file_block_start") == 0) & F.startswith("value", F.lit("\ufeff"))
    bare = F.substring(F.col("value").cast("binary"), F.lit(4), F.octet_length("value") - 3).cast("string")
    stretch = F.shiftright(F.col("id").bitwiseAND(F.lit((1 << 33) - 1)), STRETCH_BITS)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        # parts of one job by their number, which may have more digits in later files
        F.coalesce(F.regexp_extract("_metadata.file_path", r"part-(\d+)[^/]*$", 1).try_cast("bigint"), F.lit(-1)).alias("number"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.when(marked, bare).otherwise(F.col("value")).alias("line"),
    )
    return lines.withColumn("block", F.col("block") + stretch)


def line_effect(line: Column, sep: str) -> Column:
    """struct(out, in): whether a line that starts outside (inside) quotes ends inside them."""
    pieces = F.split(F.decode(line.cast("binary"), "ISO-8859-1"), '"')
    before = F.slice(pieces, 1, F.size(pieces) - 1)  # what stands before each quote

    def after_quote(state: Column, piece: Column) -> Column:
        opens = F.when(piece.endswith(sep), INSIDE)
        return (
            F.when(state == INSIDE, CLOSED)
            .when((state != TEXT) & (piece == ""), INSIDE)
            .otherwise(F.coalesce(opens, F.lit(TEXT)))
        )

    both = F.aggregate(
        before, F.struct(F.lit(FIELD).alias("out"), F.lit(INSIDE).alias("in")),
        lambda s, p: F.struct(after_quote(s["out"], p).alias("out"), after_quote(s["in"], p).alias("in")),
    )
    ends = F.struct((both["out"] == INSIDE).alias("out"), (both["in"] == INSIDE).alias("in"))
    kept = F.struct(F.lit(False).alias("out"), F.lit(True).alias("in"))
    return F.when(F.contains(line, F.lit('"')), ends).otherwise(kept)


def _folded(df: DataFrame, groups: list[str], order: str, effect: str) -> DataFrame:
    """``df`` with ``before`` and ``after``: what all rows of a group before (up to) each row make of either state.

    A row that leads to one state whatever it starts from decides; after it, only changes of state count.
    """
    so_far = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out, in_ = F.col(f"{effect}.out"), F.col(f"{effect}.in")
    flips = F.sum(F.when(out & ~in_, 1).otherwise(0))
    counted = df.withColumn("__flips", flips.over(so_far))
    fixed = F.when(out == in_, F.struct(F.col("__flips").alias("flips"), out.alias("state")))
    for name, rows in (("before", earlier), ("after", so_far)):
        last = F.last(fixed, True).over(rows)
        seen = F.coalesce(F.last("__flips").over(rows), F.lit(0))
        counted = counted.withColumn(f"__{name}", F.struct(last.alias("last"), seen.alias("seen")))
    odd = lambda n: F.pmod(n, F.lit(2)) == 1

    def made(name: str) -> Column:
        last, seen = F.col(f"__{name}.last"), F.col(f"__{name}.seen")
        decided = last["state"] != odd(seen - last["flips"])
        return F.struct(F.coalesce(decided, odd(seen)).alias("out"), F.coalesce(decided, ~odd(seen)).alias("in"))

    return counted.select(*df.columns, made("before").alias("before"), made("after").alias("after"))


def split_states(lines: DataFrame, sep: str) -> DataFrame:
    """(file, number, block, inside, chain, goes_on), one row for each split of ``raw_lines``.

    ``inside``: whether the split starts inside quotes. ``goes_on``: whether its last record does not end in it.
    ``chain``: the split in which the record that it starts inside of began.
    """
    effects = lines.select(*SPLIT, "id", line_effect(F.col("line"), sep).alias("effect"))
    # most lines leave the state as it is and need not be sent
    changing = effects.filter(F.col("effect.out") | ~F.col("effect.in"))
    ends = effects.groupBy(*SPLIT).agg(F.max("id").alias("last_id"))
    steps = _folded(changing, SPLIT, "id", "effect").join(ends, SPLIT)
    last = F.max_by("after", "id")
    # a split that starts inside has a record of its own if some line but the last one leads outside
    leaves = F.max(~F.col("after.in") & (F.col("id") < F.col("last_id")))
    per_split = steps.groupBy(*SPLIT).agg(last.alias("effect"), leaves.alias("leaves"))
    kept = F.struct(F.lit(False).alias("out"), F.lit(True).alias("in"))
    splits = ends.join(per_split, SPLIT, "left").select(
        *SPLIT, F.coalesce("effect", kept).alias("effect"), F.coalesce("leaves", F.lit(False)).alias("leaves")
    )
    # one row for each split of a file
    folded = _folded(splits, ["file"], "block", "effect").withColumn("inside", F.col("before.out"))
    ahead = Window.partitionBy("file").orderBy("block")
    behind = ahead.rowsBetween(Window.unboundedPreceding, -1)
    began = F.when(~F.col("inside") | F.col("leaves"), F.col("block"))
    return folded.select(
        *SPLIT, "inside", F.last(began, True).over(behind).alias("chain"),
        F.coalesce(F.lead("inside").over(ahead), F.lit(False)).alias("goes_on"),
    )


def read_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file, number, block, rec, record): the records of delimited files, as bytes and in any charset that extends ASCII.

    ``rec`` counts from 1 in the split where a record starts. Blank records and a byte order mark are left out; a
    carriage return at the end belongs to the line break. Quotes that are never closed reach to the end of
    their file. The records are written once, to the shared folder, but for those that cross edges.
    """
    lines = raw_lines(spark, path)
    states = split_states(lines, sep)
    # the lines of a split go to one task and are put in their order there
    placed = _folded(lines.withColumn("effect", line_effect(F.col("line"), sep)).join(states, SPLIT), SPLIT, "id", "effect")
    within = F.when(F.col("inside"), F.col("before.in")).otherwise(F.col("before.out"))
    blank = ~within & F.col("line").isin("", "\r")
    so_far = Window.partitionBy(*SPLIT).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.select(*SPLIT, "id", "line", "chain", "goes_on", within.alias("within"), blank.alias("blank")).filter(~F.col("blank"))
    numbered = numbered.withColumn("rec", F.sum(F.when(F.col("within"), 0).otherwise(1)).over(so_far))
    in_order = lambda *c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*c))), lambda x: x[c[-1]]), "\n")
    whole = numbered.groupBy(*SPLIT, "rec", "chain", "goes_on").agg(in_order("id", "line").alias("record"))
    is_last = F.col("rec") == F.max("rec").over(Window.partitionBy(*SPLIT))
    pieces = checkpoint(whole.withColumn("open", (F.col("rec") == 0) | (is_last & F.col("goes_on"))))
    # pieces of records that cross edges, at most two of a split
    edge = pieces.filter("open").withColumn("first", F.when(F.col("rec") > 0, F.col("block")).otherwise(F.col("chain")))
    edge = edge.groupBy("file", "number", F.col("first").alias("start")).agg(F.max("rec").alias("rec"), in_order("block", "record").alias("record"))
    edge = edge.select("file", "number", F.col("start").alias("block"), "rec", "record")
    found = pieces.filter("NOT open").select(*SPLIT, "rec", "record").unionByName(edge)
    data, size = F.col("record").cast("binary"), F.octet_length("record")
    cut = F.when(F.endswith("record", F.lit("\r")), F.substring(data, F.lit(1), size - 1)).otherwise(data)
    return found.withColumn("record", cut)


def decoded(records: DataFrame) -> DataFrame:
    """``records`` with ``record`` as text: UTF-8 where all of a file is, else cp1252, or Latin-1 if that has gaps.

    The charset is a property of the whole file, found by partial aggregates.
    """
    latin = F.decode("record", "ISO-8859-1")
    verdict = records.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8(F.col("record").cast("string"))).alias("utf8"),
        F.bool_or(latin.rlike(CP1252_UNDEFINED)).alias("undefined"),
    )
    text = (
        F.when(F.col("utf8"), F.col("record").cast("string"))
        .when(F.col("undefined"), latin)
        .otherwise(F.translate(latin, CP1252_FROM, CP1252_TO))
    )
    return lookup_join(records, verdict, "file").select(*SPLIT, "rec", text.alias("record"))


def scan_records(
    spark: SparkSession,
    path: str,
    schema: T.StructType | list[str] | None = None,
    header: bool = False,
    sep: str = ",",
    row_idx: str | None = None,
) -> DataFrame:
    """The fields of all records: by ``schema``, as strings of the given names, or of the header's names or _c0, _c1, ...

    With ``header`` the first record of each file is left out. ``row_idx`` adds a column that numbers the rows 0, 1,
    2, ... by file and place. Records are found as by ``read_records``, in the charsets of ``decoded``. An empty
    unquoted field is null. No file with a record gives an empty table, which then needs a schema or names.
    """
    records = decoded(read_records(spark, path, sep))
    # an empty field gives the null value, an empty one in quotes does not
    options = {"sep": sep, "nullValue": "\0", "quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n", "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}
    first = records.groupBy("number", "file").agg(F.min(F.struct("block", "rec")).alias("first"))
    if schema is None:
        start = records.join(first, ["number", "file"]).filter(F.struct("block", "rec") == F.col("first")).orderBy("number", "file")
        line = start.select("record").first()
        if line is None:
            raise ValueError("no record to take the names from")
        fields = spark.createDataFrame([(line["record"],)], "record string").select(
            F.from_csv("record", ", ".join(f"`{i}` string" for i in range(line["record"].count(sep) + 1)), options).alias("f")
        ).first()["f"]
        found = list(fields)
        while len(found) > 1 and found[-1] is None:  # a separator inside quotes is none
            found.pop()
        schema = found if header else [f"_c{i}" for i in range(len(found))]
    if isinstance(schema, list):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in schema])
    rows = records
    if header:
        rows = rows.join(first.select("file", F.col("first.block").alias("block"), F.col("first.rec").alias("rec")), ["file", "block", "rec"], "left_anti")
    number = []
    if row_idx:
        counts = rows.groupBy(*SPLIT).agg(F.count("*").alias("n"), F.min("rec").alias("least"))
        before = Window.orderBy("number", "file", "block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*SPLIT, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("shift"))
        rows = rows.join(offsets, SPLIT)
        number = [(F.col("rec") + F.col("shift")).alias(row_idx)]
    parsed = F.from_csv("record", _ddl(schema), options)
    return rows.select(*number, "file", parsed.alias("__row")).select(*([row_idx] if row_idx else []), "file", "__row.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
