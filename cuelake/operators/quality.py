"""Data quality, monitoring and retention."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions.time import TIMECODE

TERMINAL = ["COMPLETED", "FAILED", "CANCELLED"]


def timecode_rule(cues: DataFrame, media: DataFrame, slack_ms: int = 5_000) -> DataFrame:
    """Per medium, the cues and those with start >= end, start < 0 or an end past the medium."""
    m = media.select("media_id", "duration_ms")
    bad = (F.col("start_ms") >= F.col("end_ms")) | (F.col("start_ms") < 0) | F.coalesce(F.col("end_ms") > F.col("duration_ms") + slack_ms, F.lit(False))
    return cues.join(m, "media_id", "left").groupBy("media_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"))


def media_reason(media: DataFrame, least_ms: int = 1_000) -> DataFrame:
    """Adds reason: the first rule a file fails, or null."""
    rules = [(F.col("size_bytes") <= 0, "empty file"), ((F.col("width") <= 0) | (F.col("height") <= 0), "no picture"), (F.col("fps") <= 0, "no frame rate"), (F.col("frame_count") <= 0, "no frames"), (F.col("duration_ms") < least_ms, "too short")]
    reason = F.when(F.col("size_bytes").isNull(), "missing")
    for test, name in rules:
        reason = reason.when(F.coalesce(test, F.lit(True)), name)
    return media.withColumn("reason", reason)


def frame_drift(before: DataFrame, after: DataFrame, tolerance: int = 5) -> DataFrame:
    j = before.select("media_id", F.col("frame_count").alias("n_in")).join(after.select("media_id", F.col("frame_count").alias("n_out")), "media_id")
    return j.filter(F.abs(F.col("n_out") - F.col("n_in")) > tolerance)


def over_long(cues: DataFrame, limit_ms: int = 10_000) -> DataFrame:
    return cues.filter(F.col("end_ms") - F.col("start_ms") > limit_ms)


def timecode_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TIMECODE))


def error_class(message: Column) -> Column:
    """The first class whose marks a message holds."""
    has = lambda *marks: message.rlike("(?i)" + "|".join(rf"\Q{m}\E" for m in marks))
    return (
        F.when(has("404", "NOT_FOUND"), "not_found").when(has("503", "UNAVAILABLE"), "unavailable")
        .when(has("429", "RESOURCE_EXHAUSTED", "quota"), "exhausted").when(has("401", "auth"), "auth").otherwise("other")
    )


def retry_delay(message: Column, default: float = 15.0) -> Column:
    """Seconds of `retry in Ns`, else of `retryDelay: Ns`, within 2..60; a default without."""
    find = lambda p: F.regexp_extract(message, p, 1).try_cast("double")
    asked = F.coalesce(find(r"(?i)retry in (\d+(?:\.\d+)?)\s*s"), find(r"(?i)retryDelay['\"]?\s*:\s*['\"]?(\d+(?:\.\d+)?)\s*s"))
    return F.when(asked.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(2.0), F.least(F.lit(60.0), asked)))


def latest_state(events: DataFrame) -> DataFrame:
    """Per job (job_id, event_id, ts_ms, state): the last state, and whether it is final."""
    last = F.max(F.struct("ts_ms", "event_id", "state")).alias("l")
    return events.groupBy("job_id").agg(last).select("job_id", F.col("l.state").alias("state"), F.col("l.ts_ms").alias("ts_ms"), F.col("l.state").isin(TERMINAL).alias("final"))


def time_in_state(events: DataFrame) -> DataFrame:
    w = W.partitionBy("job_id").orderBy("ts_ms", "event_id")
    return events.withColumn("_d", F.lead("ts_ms").over(w) - F.col("ts_ms")).groupBy("job_id", "state").agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("in_state_ms"))


def pool_summary(events: DataFrame, expired: list[str]) -> DataFrame:
    bad = F.col("state").isin(expired)
    return latest_state(events).agg(F.count_if(~bad).alias("active"), F.count_if(bad).alias("expired"), F.count("*").alias("total"))


def batch_summary(states: DataFrame, by: list[str]) -> DataFrame:
    return states.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("state").isin(TERMINAL)).alias("completed"), F.count_if(F.col("state") == "COMPLETED").alias("success"), F.count_if(F.col("state") == "FAILED").alias("failed"))


def run_report(events: DataFrame) -> DataFrame:
    """Per job a JSON report: last status of each step, errors, elapsed time."""
    steps = events.groupBy("job_id", "state").agg(F.max("ts_ms").alias("ts_ms"), F.count("*").alias("n"))
    g = steps.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("state", "n"))).alias("steps"), F.coalesce(F.sum(F.when(F.col("state") == "FAILED", F.col("n"))), F.lit(0)).alias("errors"))
    span = events.groupBy("job_id").agg((F.max("ts_ms") - F.min("ts_ms")).alias("elapsed_ms"))
    return g.join(span, "job_id").select("job_id", F.to_json(F.struct("steps", "errors", "elapsed_ms")).alias("report"))


def missing_outputs(plan: DataFrame, results: DataFrame, key: str) -> DataFrame:
    return plan.join(results.select(key).distinct(), key, "left_anti")


def keep_latest(rows: DataFrame, by: str, order: list[Column], n: int = 50) -> DataFrame:
    """The newest n rows of each group (ties settled by the later order columns)."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def rotate_logs(lines: DataFrame, limit_bytes: int = 1 << 20, keep: int = 500, marker: str = "--- rotated ---") -> DataFrame:
    """Logs (log, line_no, text) over the limit keep their last lines behind a marker line."""
    size = lines.groupBy("log").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("_bytes"))
    long = F.col("_bytes") > limit_bytes
    sized = lines.join(size.hint("merge"), "log")
    # of the long ones alone: the filter on the number then cuts each partition before the exchange
    last = sized.filter(long).withColumn("_n", F.row_number().over(W.partitionBy("log").orderBy(F.desc("line_no")))).filter(F.col("_n") <= keep)
    kept = sized.filter(~long).select("log", "line_no", "text").unionByName(last.select("log", "line_no", "text"))
    marks = size.filter(long).select("log", F.lit(-1).cast(lines.schema["line_no"].dataType).alias("line_no"), F.lit(marker).alias("text"))
    return kept.unionByName(marks)
