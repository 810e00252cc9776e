"""Keyed tables: what changes, and what does not move."""
import os

from pyspark.sql import functions as F

from cuelake.operators.keyed import KeyedTable
from cuelake.streaming import cues as st


def files(path):
    return {os.path.join(at, n): os.stat(os.path.join(at, n)).st_mtime_ns for at, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def rows(table, spark):
    return sorted(tuple(r) for r in table.read(spark).select("k", "v").collect())


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    base = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit("old").alias("v"))
    table = KeyedTable.create(base, f"{tmp_path}/t", "k", buckets=8)
    before = files(tmp_path)
    assert len(before) == 8
    table.upsert(spark.createDataFrame([("3", "new"), ("500", "new"), (None, "x"), ("3", "mew")], "k string, v string"))
    after = files(tmp_path)
    touched = {os.path.dirname(p) for p in set(after) - set(before)}
    assert 1 <= len(touched) <= 2
    assert {p: t for p, t in before.items() if os.path.dirname(p) not in touched} == {p: t for p, t in after.items() if os.path.dirname(p) not in touched}
    want = {str(i): "old" for i in range(200)} | {"3": "new", "500": "new"}
    assert rows(table, spark) == sorted(want.items())
    table.upsert(spark.createDataFrame([("3", "never"), ("501", "new")], "k string, v string"), overwrite=False)
    assert rows(table, spark) == sorted((want | {"501": "new"}).items())
    table.upsert(base.limit(0))
    assert rows(table, spark) == sorted((want | {"501": "new"}).items())


def test_delete_may_empty_a_bucket(spark, tmp_path):
    base = spark.range(40).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    table = KeyedTable.create(base, f"{tmp_path}/t", "k", buckets=4)
    gone = base.filter(F.pmod(F.xxhash64("k"), F.lit(4)) == 2)
    table.delete(gone.union(spark.createDataFrame([(999, 1)], "k bigint, v int")))
    assert rows(table, spark) == sorted(tuple(r) for r in base.exceptAll(gone).collect())
    table.upsert(gone)
    assert rows(table, spark) == sorted(tuple(r) for r in base.collect())


def test_a_stream_in_update_mode(spark, tmp_path):
    kind = "job_id bigint, event_id bigint, ts_ms bigint, state string"
    parts = [[(1, 0, 0, "a"), (2, 1, 5, "b")], [(1, 2, 9, "c")], [(3, 3, 1, "d"), (1, 4, 2, "late")]]
    for p in parts:
        spark.createDataFrame(p, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = KeyedTable.create(spark.createDataFrame([], "job_id bigint, state string, n bigint"), f"{tmp_path}/t", "job_id", buckets=4)
    assert table.read(spark).count() == 0
    for _ in range(2):  # again: nothing new, nothing changes
        table.follow(st.progress(st.read_stream(spark, f"{tmp_path}/in", kind, files_per_batch=1)), f"{tmp_path}/cp")
        got = sorted(tuple(r) for r in table.read(spark).select("job_id", "state", "n").collect())
        assert got == [(1, "c", 3), (2, "b", 1), (3, "d", 1)]
