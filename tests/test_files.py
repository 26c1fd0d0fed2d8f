import pytest
from pyspark.sql import functions as F

from textmill.sources import files, scratch


def test_csv_keeps_quotes_breaks_and_order(spark, tmp_path):
    rows = [("0", 'say "hi", ok'), ("1", "two\nlines"), ("2", " spaced "), ("3", "back\\slash")]
    path = str(tmp_path / "t")
    files.write_table(spark.createDataFrame(rows, "a string, b string").coalesce(1), path, "csv", header=False)
    back = files.with_row_idx(files.read_csv(spark, path, multi_line=True)).orderBy("row_idx").collect()
    assert [tuple(r)[1:] for r in back] == rows
    assert [r["row_idx"] for r in back] == [0, 1, 2, 3]


def test_row_idx_over_many_splits(spark, tmp_path):
    path = str(tmp_path / "n")
    spark.range(0, 5000, 1, 7).select(F.col("id").cast("string")).write.csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = files.with_row_idx(files.read_csv(spark, path))
        assert rows.filter(F.col("row_idx") != F.col("_c0").cast("long")).count() == 0
        assert rows.select("row_idx").distinct().count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_charsets(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿1,é €\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("2,é €\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes(b"3,\xe9 \x81\n")
    rows = files.normalise_csv(spark, str(tmp_path), ["id", "text"]).select("id", "text").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "é €"), ("2", "é €"), ("3", "é \x81")]


@pytest.mark.parametrize("line, sep", [("a,b,c", ","), ("a|b|c, d", "|"), ("a", ",")])
def test_delimiter(spark, tmp_path, line, sep):
    (tmp_path / "x.txt").write_text(f"{line}\n" + ("e|f|g\n" if sep == "|" else f"{line}\n"))
    assert files.choose_delimiter(spark, str(tmp_path)) == sep


def test_keywords(spark, tmp_path):
    (tmp_path / "k.txt").write_text(" Good , fine,,GOOD , ")
    assert sorted(r[0] for r in files.keyword_list(spark, str(tmp_path)).collect()) == ["fine", "good"]


def test_checkpoint_folder_comes_from_the_session(spark):
    assert scratch.shared_folder(spark)
    assert scratch.checkpoint(spark.range(3)).count() == 3
