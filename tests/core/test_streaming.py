"""One batch or many: streaming answers equal the batch ones."""
import pytest
from pyspark.sql import functions as F

from cuelake.operators import folds
from cuelake.streaming import cues as st

CUE = "media_id bigint, ord bigint, start_ms bigint, end_ms bigint, text string"


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_batch(spark, tmp_path, files):
    texts = ["hello world", "hello world!", "other", "other one"]
    rows = [(m, i, 900 * i, 900 * i + 700, texts[i // 3 % 4]) for m in range(3) for i in range(40)]
    frame = spark.createDataFrame(rows, CUE)
    for k in range(files):
        part = frame.filter((F.col("ord") >= 40 * k // files) & (F.col("ord") < 40 * (k + 1) // files))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = st.read_stream(spark, f"{tmp_path}/in", CUE, files_per_batch=1).withColumn("ts", F.timestamp_millis(F.col("start_ms") + 1_700_000_000_000))
    st.drain(st.dedupe_stream(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.media_id, r.ord, r.start_ms, r.end_ms, r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect() if not r.late}
    want = {(r.media_id, r.ord, r.start_ms, r.end_ms, r.text) for r in folds.dedupe_overlap(frame).collect()}
    # the cue still open at the end waits for the watermark
    assert got <= want and len(want - got) <= 3


def test_ingest_resumes_without_repeats(spark, tmp_path):
    frame = spark.range(10).withColumnRenamed("id", "a")
    for _ in range(2):
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        st.ingest(st.read_stream(spark, f"{tmp_path}/in", "a bigint", files_per_batch=1), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20


def test_sampled_stream_equals_batch(spark, tmp_path):
    texts = ["same text", "same text!", "", "", "", "other"]
    rows = [(m, i, 700 * i, texts[(i * 7 + m) % 6], 1_000_000) for m in range(2) for i in range(60)]
    kind = "media_id bigint, ord bigint, t_ms bigint, text string, duration_ms bigint"
    frame = spark.createDataFrame(rows, kind)
    for k in range(3):
        frame.filter((F.col("ord") >= 20 * k) & (F.col("ord") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = st.read_stream(spark, f"{tmp_path}/in", kind, files_per_batch=1).withColumn("ts", F.timestamp_millis(F.col("t_ms") + 1_700_000_000_000))
    st.drain(st.sample_stream(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    done = spark.read.parquet(f"{tmp_path}/out").unionByName(st.still_open(spark, f"{tmp_path}/cp"))
    got = sorted((r.media_id, r.ord, r.start_ms, r.end_ms, r.text) for r in done.filter("NOT late").collect())
    assert got == sorted((r.media_id, r.ord, r.start_ms, r.end_ms, r.text) for r in folds.sampled_cues(frame, brief=True).collect())


def test_late_samples_change_nothing(spark, tmp_path):
    kind = "media_id bigint, ord bigint, t_ms bigint, text string, duration_ms bigint"
    parts = [[(1, 0, 0, "a line", 99_000), (1, 1, 900, "a line", 99_000)], [(1, 2, 300, "late line", 99_000), (1, 3, 400, "", 99_000)], [(1, 4, 1_500, "a line", 99_000)]]
    for rows in parts:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = st.read_stream(spark, f"{tmp_path}/in", kind, files_per_batch=1).withColumn("ts", F.timestamp_millis(F.col("t_ms") + 1_700_000_000_000))
    st.drain(st.sample_stream(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    done = spark.read.parquet(f"{tmp_path}/out").unionByName(st.still_open(spark, f"{tmp_path}/cp"))
    assert sorted((r.ord, r.start_ms, r.end_ms, r.late) for r in done.collect()) == [(0, 0, 3_000, False), (2, 300, 1_800, True)]


def test_late_rows_of_batches_equal_the_table(spark, tmp_path):
    rows = [(m, i, (i * 37 + m * 11) % 90 * 1_000 + 1_000 * i, 0, "x") for m in range(3) for i in range(60)]
    kind = "media_id bigint, ord bigint, start_ms bigint, end_ms bigint, text string"
    frame = spark.createDataFrame(rows, kind)
    for k in range(3):
        frame.filter((F.col("ord") >= 20 * k) & (F.col("ord") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    st.split_late(st.read_stream(spark, f"{tmp_path}/in", kind, files_per_batch=1), 30_000, f"{tmp_path}/on", f"{tmp_path}/late", f"{tmp_path}/cp")
    late = {(r.media_id, r.ord) for r in spark.read.parquet(f"{tmp_path}/late").collect()}
    assert late and late == {(r.media_id, r.ord) for r in st.mark_late(frame, 30_000).filter("late").collect()}
    assert spark.read.parquet(f"{tmp_path}/on").count() + len(late) == len(rows)


CUE_TS = "media_id bigint, ord bigint, start_ms bigint, end_ms bigint, text string, at_ms bigint"


def arrivals(spark, tmp_path, batches, kind=CUE):
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return st.read_stream(spark, f"{tmp_path}/in", kind, files_per_batch=1)


def test_sessions_come_out_once_and_end(spark, tmp_path):
    batches = [[(1, 0, 0, 500, "a"), (1, 1, 900, 1_000, "b"), (2, 0, 50_000, 51_000, "c")], [(1, 2, 200_000, 201_000, "d"), (1, 3, 202_500, 203_000, "e")], [(2, 1, 400_000, 400_500, "f")]]
    stream = arrivals(spark, tmp_path, batches).withColumn("ts", F.timestamp_millis("start_ms"))
    st.drain(st.sessions(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    closed, waiting = spark.read.parquet(f"{tmp_path}/out"), st.open_sessions(spark, f"{tmp_path}/cp")
    assert sorted(tuple(r) for r in waiting.collect()) == [(2, 400_000, 400_500, 1)]
    frame = spark.createDataFrame([r for b in batches for r in b], CUE).withColumn("ts", F.timestamp_millis("start_ms"))
    assert sorted(tuple(r) for r in closed.unionByName(waiting).collect()) == sorted(tuple(r) for r in st.sessions(frame).collect())


def test_rows_behind_the_watermark(spark, tmp_path):
    """Batches out of order, an idle medium whose state ends, and a row at the watermark itself."""
    day = 1_700_000_000_000
    batches = [[(1, 0, 0, 1, "a", day + 50_000), (2, 0, 0, 1, "a", day)], [(1, 1, 0, 1, "b", day + 20_000), (1, 2, 0, 1, "b", day + 20_001), (3, 0, 0, 1, "b", day + 400_000)], [(2, 1, 0, 1, "c", day + 399_000), (1, 3, 0, 1, "c", day + 1_000)], [(2, 2, 0, 1, "d", day + 398_000)]]
    stream = arrivals(spark, tmp_path, batches, CUE_TS).withColumn("ts", F.timestamp_millis("at_ms")).drop("at_ms")
    st.split_rows(st.mark_behind(stream, "30 seconds", keep_ms=60_000), f"{tmp_path}/on", f"{tmp_path}/late", f"{tmp_path}/cp")
    on = sorted((r.media_id, r.ord, r.behind_ms) for r in spark.read.parquet(f"{tmp_path}/on").collect())
    late = sorted((r.media_id, r.ord, r.behind_ms) for r in spark.read.parquet(f"{tmp_path}/late").collect())
    # watermarks: none, day + 20,000, day + 370,000 (which ends the state of 1 and 2), the same
    assert late == [(1, 1, 30_000), (1, 3, 49_000)]
    assert on == [(1, 0, 0), (1, 2, 29_999), (2, 0, 0), (2, 1, 0), (2, 2, 1_000), (3, 0, 0)]
    state = spark.read.format("statestore").option("stateVarName", "latest").load(f"{tmp_path}/cp").select("key.media_id", "value.at").collect()
    assert {r.media_id: r.at - day for r in state} == {2: 399_000, 3: 400_000}


def test_a_cue_behind_the_watermark_is_not_lost(spark, tmp_path):
    batches = [[(1, 0, 0, 700, "hello world"), (2, 0, 900_000, 900_700, "far ahead")], [(3, 0, 1_000, 1_700, "another medium")]]
    stream = arrivals(spark, tmp_path, batches).withColumn("ts", F.timestamp_millis(F.col("start_ms") + 1_700_000_000_000))
    st.drain(st.dedupe_stream(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    out = {(r.media_id, r.late) for r in spark.read.parquet(f"{tmp_path}/out").unionByName(st.still_open(spark, f"{tmp_path}/cp")).collect()}
    assert out == {(1, False), (2, False), (3, True)}
