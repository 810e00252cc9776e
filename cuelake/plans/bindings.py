"""Views of the given tables as cues, frames, detections, lexicon and jobs.

Each view has a DataFrame and the same rows as SQL text for a `WITH` clause.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by key before costly work on each: few bytes may be much work, and a small file is one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cues of one medium a user: an hour of event time is a second of media time."""
    e = table(spark, sf_dir, "events")
    start = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / 3_600_000).cast("bigint")
    duration = F.floor(F.round(F.col("value") * 100).cast("bigint") / 2).cast("bigint")
    return e.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("ord"), start.alias("start_ms"), duration.alias("dur_ms"),
                    (start + duration).alias("end_ms"), F.col("event_type").alias("text"),
                    F.get_json_object("props", "$.k").cast("int").alias("confidence_pct"))


V_CUES = f"""v_cues AS (SELECT user_id AS media_id, event_id AS ord, (epoch_us(ts) - {EPOCH_US}) // 3600000 AS start_ms,
 CAST(round(value * 100) AS BIGINT) // 2 AS dur_ms, (epoch_us(ts) - {EPOCH_US}) // 3600000 + CAST(round(value * 100) AS BIGINT) // 2 AS end_ms,
 event_type AS text, CAST(props->>'$.k' AS INTEGER) AS confidence_pct FROM events)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of prose as cues without times."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("media_id"), "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


V_LINES = """v_lines AS (SELECT doc_id AS media_id, lang, source, unnest(string_split(text, chr(10))) AS text,
 CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no FROM documents)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as media files."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        o.alias("media_id"), (o % 3 * 5 + 20).cast("int").alias("fps"), (o % 7 * 160).cast("int").alias("width"), (o % 5 * 90).cast("int").alias("height"),
        (o % 11 * 500).cast("bigint").alias("frame_count"), (o % 13 * 7_919).cast("bigint").alias("size_bytes"), (o % 17 * 2_500).cast("bigint").alias("duration_ms"),
        F.concat(F.lit("file"), o.cast("string"), F.lit(".mp4")).alias("path"),
    )


V_MEDIA = """v_media AS (SELECT o_orderkey AS media_id, CAST(o_orderkey % 3 * 5 + 20 AS INTEGER) AS fps, CAST(o_orderkey % 7 * 160 AS INTEGER) AS width,
 CAST(o_orderkey % 5 * 90 AS INTEGER) AS height, o_orderkey % 11 * 500 AS frame_count, o_orderkey % 13 * 7919 AS size_bytes,
 o_orderkey % 17 * 2500 AS duration_ms, 'file' || o_orderkey || '.mp4' AS path FROM orders)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as text boxes of a frame an order; coordinates in whole pixels."""
    p, s = F.col("l_partkey") % 600, F.col("l_suppkey") % 300
    w, h = (F.col("l_quantity").cast("int") + 10), (F.col("l_linenumber") * 3 + 8)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")).alias("ord"), p.cast("int").alias("x"), s.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"),
        F.round(F.col("l_discount") * 1000).cast("int").alias("conf_pct"),
        F.when(F.col("l_linenumber") == 4, F.lit(" ")).when(F.col("l_linenumber") == 5, F.lit(",")).otherwise(F.concat("l_returnflag", "l_linestatus")).alias("text"),
    )


V_DETECTIONS = """v_det AS (SELECT l_orderkey AS frame, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INTEGER) AS ord, CAST(l_partkey % 600 AS INTEGER) AS x, CAST(l_suppkey % 300 AS INTEGER) AS y,
 CAST(trunc(l_quantity) AS INTEGER) + 10 AS w, CAST(l_linenumber * 3 + 8 AS INTEGER) AS h, CAST(round(l_discount * 1000) AS INTEGER) AS conf_pct,
 CASE l_linenumber WHEN 4 THEN ' ' WHEN 5 THEN ',' ELSE l_returnflag || l_linestatus END AS text FROM lineitem)"""

#: (layer, priority, line): a small lexicon over words of the prose; later layers win.
LEXICON_LINES = [
    ("Babylon", 1, "the=le; la[art]"), ("Babylon", 1, "and=et; puis"), ("Babylon", 1, "of=de"), ("LacViet", 2, "and=✚[conj] và; cùng"),
    ("LacViet", 2, "for=pour, car"), ("ThieuChuu", 3, "is=est[v], sont"), ("PhienAm", 4, "with=avec|chez"), ("VietPhrase", 5, "the=der/die/das"),
    ("VietPhrase", 5, "in=en/dans"), ("VietPhrase", 5, "für=pour"), ("VietPhrase", 5, "été=était;fut"), ("ChineseModern", 6, "# note=none"),
    ("ChineseModern", 6, "you=vous|tu"), ("ChineseModern", 6, "you=ihr|euch"), ("Names", 7, "une=eine/ein"), ("Names", 7, "not a pair"), ("Names", 7, "=empty"),
    ("Names", 7, "las="), ("Names", 7, "niño=Kind/Bub; Junge"),
]


def lexicon_lines(spark: SparkSession) -> DataFrame:
    rows = [(layer, priority, n, line) for n, (layer, priority, line) in enumerate(LEXICON_LINES)]
    return spark.createDataFrame(rows, "layer string, priority int, line_no int, line string")


_q = lambda s: "'" + s.replace("'", "''") + "'"
V_LEXICON_LINES = "v_lex AS (SELECT * FROM (VALUES " + ", ".join(f"({_q(a)}, {p}, {n}, {_q(t)})" for n, (a, p, t) in enumerate(LEXICON_LINES)) + ") t(layer, priority, line_no, line))"

#: Plain pairs for replacement over the prose; outputs feed later keys.
PAIRS = [("the", "le"), ("and", "und"), ("tion", "sion"), ("sion", "ssion"), ("is", "ist"), ("on", "auf"), ("er", "re"), ("of", "von"), ("que", "dass"), ("ou", "oder")]


def pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(PAIRS)], "ord int, key string, value string")


V_PAIRS = "v_pairs AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(k)}, {_q(v)})" for i, (k, v) in enumerate(PAIRS)) + ") t(ord, key, value))"


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as state changes of jobs."""
    state = F.element_at(F.array(*map(F.lit, ["QUEUED", "RUNNING", "FAILED", "COMPLETED", "CANCELLED"])), (F.col("event_id") % 5 + 1).cast("int"))
    return cues(spark, sf_dir).select(F.col("media_id").alias("job_id"), F.col("ord").alias("event_id"), F.col("start_ms").alias("ts_ms")).withColumn("state", state)


V_JOBS = "v_jobs AS (SELECT media_id AS job_id, ord AS event_id, start_ms AS ts_ms, (['QUEUED','RUNNING','FAILED','COMPLETED','CANCELLED'])[CAST(ord % 5 + 1 AS INTEGER)] AS state FROM v_cues)"

#: Messages of provider errors for classification.
MESSAGES = ["404 NOT_FOUND model", "503 UNAVAILABLE", "429 RESOURCE_EXHAUSTED retry in 17.5s", "quota exceeded 'retryDelay': '1s'", "401 invalid auth", "socket closed", "Please retry in 90s."]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % len(MESSAGES) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("job_id"), pick.alias("message"))


V_MESSAGES = "v_msg AS (SELECT event_id, user_id AS job_id, ([" + ", ".join(map(_q, MESSAGES)) + f"])[CAST(event_id % {len(MESSAGES)} + 1 AS INTEGER)] AS message FROM events)"
