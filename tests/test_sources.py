"""Workbooks, lists and streams."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions.profiles import LATIN
from inkwell.operators import sentiment
from inkwell.sources import excel
from inkwell.streaming import scoring


def test_workbook_round_trip(spark, tmp_path):
    rows = [(1, "维持“买入”评级<?>风险 & <b>", 3, None), (2, None, -7, 1.5), (3, "  a\nb ", 0, 2.0)]
    df = spark.createDataFrame(rows, "row_no long, `研报文本` string, wordcount int, x double").repartition(3)
    path = f"file://{tmp_path}/out.xlsx"
    excel.write_excel(df, path)
    got = excel.read_excel(spark, path, {"text": "研报文本", "wordcount": "wordcount", "x": "x"}).orderBy("row_no").collect()
    assert [(r["row_no"], r["text"], int(r["wordcount"]), r["x"] and float(r["x"])) for r in got] == rows


def test_sources_are_not_written_to(spark):
    with pytest.raises(ValueError, match="source"):
        excel.write_excel(spark.range(1).select(F.col("id").alias("row_no")), "file:///a/b.xlsx", sources=("file:///a/b.xlsx",))


def test_what_was_read_is_not_written_to(spark, tmp_path):
    (tmp_path / "s.xlsx").write_bytes(b"".join(excel.build(["x"], [["1"]])))
    got = excel.read_excel(spark, f"file://{tmp_path}/s.xlsx", {"x": "x"})
    with pytest.raises(ValueError, match="source"):
        excel.write_excel(got, f"{tmp_path}/s.xlsx")


def test_a_workbook_comes_in_chunks():
    rng = random.Random(1)
    rows = [[i, "".join(rng.choices("abcdefghij <&", k=250))] for i in range(2_000)]
    chunks = list(excel.build(["n", "t"], rows, chunk=2_000))
    assert len(chunks) > 5
    header, *got = excel.parse(b"".join(chunks))
    assert header == ["n", "t"]
    assert [[int(a), b] for a, b in got] == rows


def test_missing_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(b"".join(excel.build(["x"], [["1"]])))
    with pytest.raises(Exception, match="not in list"):
        excel.read_excel(spark, f"file://{tmp_path}/a.xlsx", {"y": "y"}).collect()


def test_word_lists(spark, tmp_path):
    (tmp_path / "w.xlsx").write_bytes(b"".join(excel.build(["词"], [["强烈"], [None], ["强烈"], ["可能"]])))
    got = excel.read_wordlist(spark, f"file://{tmp_path}/w.xlsx", "词", "strength", last=3).collect()
    assert [(r["word"], r["dim"]) for r in got] == [("强烈", "strength")]


def test_character_lists_are_checked(spark, tmp_path):
    data = "的一\n是的".encode()
    (tmp_path / "c.txt").write_bytes(data)
    path = f"file://{tmp_path}/c.txt"
    assert {r["ch"] for r in excel.read_charlist(spark, path, 1, hashlib.sha256(data).hexdigest()).collect()} == set("的一是")
    with pytest.raises(ValueError, match="checksum"):
        excel.read_charlist(spark, path, 1, "0" * 64)


def test_streamed_scores_are_the_batch_scores(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d.repartition(3).write.parquet(f"{tmp_path}/in")
    scored = scoring.sentiment_stream(scoring.read_reports(spark, f"{tmp_path}/in"), LATIN)
    scoring.start(scored, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").exceptAll(sentiment.scores(sentiment.counts(d, LATIN))).count() == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 200
