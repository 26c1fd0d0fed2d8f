import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from textmill.sources import records


@pytest.fixture
def small_splits(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(rng, n):
    parts = ["a", "é", ",", '"', '""', "\n", "\n\n", " ", "word", "\t", "😀", "|", "x" * 300]
    return [[f"{i}", "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) or None, rng.choice(["k", "l\nm"])] for i in range(n)]


def written(rows, **kw):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", **kw).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("size", [64, 700, 1 << 20])
def test_records_of_two_files_over_the_edges_of_splits(spark, tmp_path, small_splits, size):
    rng = random.Random(size)
    rows = made(rng, 400)
    (tmp_path / "part-1.csv").write_text(written(rows[:250]), newline="")
    (tmp_path / "part-2.csv").write_text("﻿" + written(rows[250:]).rstrip("\n"), newline="")
    small_splits(size)
    found = records.scan_records(spark, str(tmp_path), ["i", "text", "k"], row_idx="row_idx").orderBy("row_idx").collect()
    assert [r.row_idx for r in found] == list(range(len(rows)))
    assert [[r.i, r.text, r.k] for r in found] == rows


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_odd_quotes_blank_lines_and_carriage_returns(spark, tmp_path, small_splits, size):
    text = 'a,5" disk\r\n\r\nb,"x\r\ny"\r\n\nc,in "the" middle\n"d","e ""q"""\n  f,g\n"h",""\n"i,\n\n\n,j",k\n' + 'l,"never closed\nmore'
    (tmp_path / "t.csv").write_bytes(text.encode())
    small_splits(size)
    found = records.scan_records(spark, str(tmp_path), ["a", "b"], row_idx="n").orderBy("n").collect()
    want = [("a", '5" disk'), ("b", "x\r\ny"), ("c", 'in "the" middle'), ("d", 'e "q"'), ("  f", "g"), ("h", ""), ("i,\n\n\n,j", "k")]
    assert [(r.a, r.b) for r in found][:-1] == want
    assert found[-1].a == "l" and "never closed\nmore" in found[-1].b


def test_a_record_over_many_splits_and_charsets(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i} é €" for i in range(3000))
    for name, charset in (("a", "utf-8"), ("b", "cp1252")):
        (tmp_path / f"{name}.csv").write_bytes(written([["1", "é"], ["2", long], ["3", 'last "one"\n€']]).encode(charset))
    small_splits(900)
    found = records.scan_records(spark, str(tmp_path), ["i", "text"])
    assert sorted((r.i, r.text) for r in found.collect()) == sorted([("1", "é"), ("2", long), ("3", 'last "one"\n€')] * 2)


def test_header_names_other_separators_and_no_rows(spark, tmp_path, small_splits):
    for k in (1, 2):
        (tmp_path / f"part-{k}.csv").write_text("\n" + written([["x|y", "text"], [f"{k}", "a\n|b"], [f"{k}", "c"]], delimiter="|"), newline="")
    small_splits(16)
    found = records.scan_records(spark, str(tmp_path), header=True, sep="|", row_idx="n").orderBy("n")
    assert found.columns == ["n", "file", "x|y", "text"]
    assert [tuple(r)[0:1] + tuple(r)[2:] for r in found.collect()] == [(0, "1", "a\n|b"), (1, "1", "c"), (2, "2", "a\n|b"), (3, "2", "c")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("\n\n")
    assert records.scan_records(spark, str(tmp_path / "none"), ["a"]).collect() == []
    with pytest.raises(ValueError):
        records.scan_records(spark, str(tmp_path / "none"))


def test_effect_of_a_line_against_reading_it(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice(['"', '"', ",", "a", " "]) for _ in range(rng.randint(0, 9))) for _ in range(400)]

    def ends_inside(line, inside):
        field, i = True, 0
        while i < len(line):
            c = line[i]
            if inside:
                if c == '"':
                    if line[i + 1 : i + 2] == '"':
                        i += 1
                    else:
                        inside = field = False
            elif c == '"' and field:
                inside, field = True, False
            else:
                field = c == ","
            i += 1
        return inside

    df = spark.createDataFrame([(t,) for t in lines], "line string").select("line", records.line_effect(F.col("line"), ",").alias("e"))
    for r in df.collect():
        assert (r.e["out"], r.e["in"]) == (ends_inside(r.line, False), ends_inside(r.line, True)), r.line


@pytest.mark.parametrize("bits", [0, 2])
def test_splits_are_cut_into_stretches_of_lines(spark, tmp_path, small_splits, monkeypatch, bits):
    rng = random.Random(bits)
    rows = made(rng, 300)
    (tmp_path / "part-1.csv").write_text(written(rows[:200]), newline="")
    (tmp_path / "part-2.csv").write_text("﻿" + written(rows[200:]), newline="")
    monkeypatch.setattr(records, "STRETCH_BITS", bits)
    small_splits(3000)
    assert records.raw_lines(spark, str(tmp_path)).groupBy(*records.SPLIT).count().agg(F.max("count")).first()[0] <= 1 << bits
    found = records.scan_records(spark, str(tmp_path), ["i", "text", "k"], row_idx="row_idx").orderBy("row_idx").collect()
    assert [r.row_idx for r in found] == list(range(len(rows)))
    assert [[r.i, r.text, r.k] for r in found] == rows
