"""Streaming queries over the event table, drained with availableNow."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.plans import bindings as b
from cuelake.operators.folds import tidied
from cuelake.operators.keyed import KeyedTable
from cuelake.operators.shared import new_path
from cuelake.plans.bindings import V_CUES, V_JOBS
from cuelake.plans.quality_queries import DEDUPED, SAMPLED, boxed_sample
from cuelake.plans.registry import query
from cuelake.streaming import cues as st

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def place(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return new_path(spark, "stream")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.read_stream(spark, f"{sf_dir}/events.parque[t]", EVENTS)  # a pattern: the table may be a file or a folder


def cue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    start = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - b.EPOCH_US) / 3_600_000).cast("bigint")
    end = start + F.floor(F.round(F.col("value") * 100).cast("bigint") / 2).cast("bigint")
    return e.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("ord"), start.alias("start_ms"), end.alias("end_ms"), F.col("event_type").alias("text"), F.timestamp_millis(start + b.EPOCH_US // 1000).alias("ts"))


@query("r1_incremental_ingest", "SELECT media_id, ord, start_ms, end_ms, text FROM v_cues", V_CUES)
def r1(spark, d):
    at = place(spark)
    st.ingest(cue_stream(spark, d).drop("ts"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").drop("batch")


@query("r2_stream_overlap_dedupe", DEDUPED + " SELECT media_id, ord, start_ms, end_ms, text, false AS late FROM dd", V_CUES)
def r2(spark, d):
    at = place(spark)
    st.drain(st.dedupe_stream(cue_stream(spark, d)), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").unionByName(st.still_open(spark, f"{at}/checkpoint")).drop("x", "y", "w", "h")


@query("r3_stream_sampled_cues", SAMPLED + " SELECT * FROM sc WHERE end_ms - start_ms >= CASE WHEN length(text) >= 4 THEN 180 ELSE 300 END", V_CUES)
def r3(spark, d):
    at = place(spark)
    samples = cue_stream(spark, d).select("media_id", "ord", F.col("start_ms").alias("t_ms"), *boxed_sample(), "ts")
    st.drain(st.sample_stream(samples, miss_ms=6_000), f"{at}/out", f"{at}/checkpoint")
    return tidied(spark.read.parquet(f"{at}/out").unionByName(st.still_open(spark, f"{at}/checkpoint")).drop("late"))


@query("r4_session_cues", """, z AS (SELECT *, max(start_ms + greatest(dur_ms, 0) + 1800) OVER (PARTITION BY media_id ORDER BY start_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_cues),
 s AS (SELECT *, sum(CASE WHEN start_ms <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY start_ms, ord ROWS UNBOUNDED PRECEDING) AS k FROM z)
 SELECT media_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM s GROUP BY media_id, k""".replace(", z AS", "WITH z AS", 1), V_CUES)
def r4(spark, d):
    at = place(spark)
    made = st.sessions(cue_stream(spark, d).withColumn("ts", F.timestamp_millis(F.col("start_ms"))))
    st.drain(made, f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").unionByName(st.open_sessions(spark, f"{at}/checkpoint"))


@query("r5_late_rows", "SELECT media_id, ord, coalesce(start_ms < max(start_ms) OVER (PARTITION BY media_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 30000, false) AS late FROM v_cues", V_CUES)
def r5(spark, d):
    at = place(spark)
    st.split_late(cue_stream(spark, d).drop("ts"), 30_000, f"{at}/on-time", f"{at}/late", f"{at}/checkpoint")
    table = lambda name, late: spark.read.parquet(f"{at}/{name}").select("media_id", "ord", F.lit(late).alias("late"))
    return table("on-time", False).unionByName(table("late", True))


#: Files in which events arrive: by id, but every seventh two files late. The watermark is the latest time of the files before less a day.
ARRIVALS, DELAY_MS = 6, 86_400_000
BEHIND = f""", ar AS (SELECT user_id AS media_id, event_id AS ord, epoch_us(ts) // 1000 AS at_ms, event_id * {ARRIVALS} // (max(event_id) OVER () + 1) + CASE WHEN event_id % 7 = 3 THEN 2 ELSE 0 END AS file FROM events),
 tops AS (SELECT file, max(at_ms) AS top FROM ar GROUP BY file), wm AS (SELECT file, max(top) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DELAY_MS} AS watermark FROM tops),
 own AS (SELECT media_id, file, max(max(at_ms)) OVER (PARTITION BY media_id ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM ar GROUP BY media_id, file)
 SELECT ar.media_id, ar.ord, coalesce(ar.at_ms <= wm.watermark, false) AS late, CAST(coalesce(greatest(own.latest - ar.at_ms, 0), 0) AS BIGINT) AS behind_ms FROM ar JOIN wm USING (file) JOIN own USING (media_id, file)""".replace(", ar AS", "WITH ar AS", 1)


@query("r5_watermark_side_table", BEHIND)
def r5b(spark, d):
    """Events dealt to files out of order, a file a batch; rows behind the watermark go to a side table."""
    at = place(spark)
    e = b.table(spark, d, "events")
    last = e.agg(F.max("event_id")).scalar()
    file = F.floor(F.col("event_id") * ARRIVALS / (last + 1)).cast("int") + F.when(F.col("event_id") % 7 == 3, 2).otherwise(0)
    dealt = e.withColumn("file", file)
    for n in range(ARRIVALS + 2):  # they arrive one after another; each is as many files as tasks read it
        dealt.filter(F.col("file") == n).drop("file").write.mode("append").parquet(f"{at}/in")
        rows = st.read_stream(spark, f"{at}/in", EVENTS, files_per_batch=1_000_000)
        cues = rows.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("ord"), F.lit(0).cast("bigint").alias("start_ms"), F.lit(0).cast("bigint").alias("end_ms"), F.col("event_type").alias("text"), F.col("ts").cast("timestamp").alias("ts"))
        st.split_rows(st.mark_behind(cues, f"{DELAY_MS} milliseconds", 400 * DELAY_MS), f"{at}/on-time", f"{at}/late", f"{at}/checkpoint")
    table = lambda name, late: spark.read.parquet(f"{at}/{name}").select("media_id", "ord", F.lit(late).alias("late"), "behind_ms")
    return table("on-time", False).unionByName(table("late", True))


@query("r6_live_progress", "SELECT job_id, arg_max(state, ts_ms * 100000000 + event_id) AS state, count(*) AS n FROM v_jobs GROUP BY job_id", V_CUES, V_JOBS)
def r6(spark, d):
    at = place(spark)
    c = cue_stream(spark, d)
    state = F.element_at(F.array(*map(F.lit, ["QUEUED", "RUNNING", "FAILED", "COMPLETED", "CANCELLED"])), (F.col("ord") % 5 + 1).cast("int"))
    jobs = c.select(F.col("media_id").alias("job_id"), F.col("ord").alias("event_id"), F.col("start_ms").alias("ts_ms"), state.alias("state"))
    table = KeyedTable.create(spark.createDataFrame([], "job_id bigint, state string, n bigint"), f"{at}/jobs", "job_id")
    table.follow(st.progress(jobs), f"{at}/checkpoint")
    return table.read(spark)
