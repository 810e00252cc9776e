"""Subtitle files written and read as a data source."""
import os
import re

import pytest
from pyspark.sql import functions as F

from cuelake.sources import files
from cuelake.sources import subtitles as s

CUE = "media_id bigint, ord bigint, start_ms bigint, end_ms bigint, text string, part string, n int"


def cues(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "extra", 9) for r in rows], CUE).repartition(parts)


def test_round_trip(spark, tmp_path):
    rows = [(m, i, 1_000 * (i // 2), 1_000 * i + 500, f"line {i} é 你好") for m in (1, 2, 30) for i in range(40)] + [(7, 0, 5, 6, None)]
    rows += [(8, i, i, i + 1, "x" * 100) for i in range(15_000)]  # over several batches
    df = cues(spark, rows)
    for _ in range(2):  # again: replaced, not added
        files.save(s.srt_parts(df), f"{tmp_path}/out")
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["1.srt", "2.srt", "30.srt", "7.srt", "8.srt"]
    for r in s.to_srt(df).collect():
        assert open(f"{tmp_path}/out/{r.media_id}.srt", encoding="utf-8", newline="").read() == r.document
    back = files.read(spark, f"{tmp_path}/out").select(F.regexp_extract("path", r"(\d+)\.srt", 1).cast("bigint").alias("media_id"), "ord", "start_ms", "end_ms", "text")
    want = s.parse_srt(s.to_srt(df).withColumnRenamed("document", "text"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect())) and back.count() == len(rows)


def test_parsing_equals_the_column_form(spark):
    texts = [
        "1\n00:00:01,5 --> 00:00:02.25\n a \n b \n\nnot text\n2\n00:00:03,000 --> 00:00:04,000\nc\n3\n00:00:05,000 --> 00:00:06,000\n",
        "00:00:01,000 --> 00:00:02,000\r\na\r\n7\r\nb --> c\r\nd\r\n00:00:03,000 --> 00:00:04,000\r12\r", "", "no cue\n-->\n", "00:00:01,000 -->\n00:00:01,000 --> 00:00:02,000 --> 00:00:09,000\nx\n٣\n00:00:05,000 --> 00:00:06,000\ny\x0bz\x1c\n",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "media_id int, text string")
    want = sorted(map(tuple, s.parse_srt(docs).collect()))
    assert sorted((i, *c) for i, x in enumerate(texts) for c in files.cues_of(re.split(r"\r\n|\r|\n", x))) == want and len(want) == 7


def test_encodings(spark, tmp_path):
    body = "1\n00:00:01,000 --> 00:00:02,000\nTiếng Việt é\n"
    held = {"a": body.encode("utf-8-sig"), "b": body.encode("utf-16"), "c": body.encode("utf-8"), "d": body.encode("utf-16-be"), "e": "1\n00:00:01,000 --> 00:00:02,000\né ß\n".encode("cp1258"), "f": b"1\n00:00:01,000 --> 00:00:02,000\n\xd2\xff!\n"}
    for k, v in held.items():
        (tmp_path / f"{k}.srt").write_bytes(v)
    (tmp_path / "other.txt").write_bytes(b"no")
    got = {os.path.basename(r.path)[0]: r.text for r in files.read(spark, str(tmp_path)).collect()}
    assert got["a"] == got["b"] == got["c"] == "Tiếng Việt é" and got["e"] == "é ß" and got["f"] == "Òÿ!"
    frame = spark.createDataFrame([(k, v) for k, v in held.items()] + [("n", None), ("z", b"")], "k string, v binary")
    assert {r.k: r.x for r in frame.select("k", s.decode_any(F.col("v")).alias("x")).collect()} == {k: s.decode_one(v) for k, v in held.items()} | {"n": None, "z": ""}


def test_a_failed_write_leaves_the_files_alone(spark, tmp_path):
    files.save(s.srt_parts(cues(spark, [(1, 0, 0, 1, "first")])), f"{tmp_path}/out")
    bad = spark.createDataFrame([("a/b", 1, "x"), ("1", 1, "y")], "media_id string, n int, part string")
    with pytest.raises(Exception, match="not a file name"):
        files.save(bad, f"{tmp_path}/out")
    assert "first" in open(f"{tmp_path}/out/1.srt").read()


def test_empty(spark, tmp_path):
    files.save(s.srt_parts(cues(spark, [(1, 0, 0, 1, "x")]).limit(0)), f"{tmp_path}/out")
    os.makedirs(f"{tmp_path}/none", exist_ok=True)
    assert files.read(spark, f"{tmp_path}/none").collect() == []
