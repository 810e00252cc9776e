"""Queries for quality and monitoring, and those of the grouped folds."""
from pyspark.sql import functions as F

from cuelake.operators import folds
from cuelake.operators import quality as q
from cuelake.plans import bindings as b
from cuelake.plans.bindings import V_CUES, V_DETECTIONS, V_JOBS, V_LINES, V_MEDIA, V_MESSAGES
from cuelake.plans.registry import query


@query("q1_timecode_rule", "SELECT c.media_id, count(*) AS n, count(*) FILTER (start_ms >= end_ms OR start_ms < 0 OR coalesce(end_ms > duration_ms + 5000, false)) AS n_bad FROM v_cues c LEFT JOIN v_media m USING (media_id) GROUP BY 1", V_CUES, V_MEDIA)
def q1(spark, d):
    return q.timecode_rule(b.cues(spark, d), b.media(spark, d))


@query("q2_media_rules", "SELECT media_id, CASE WHEN size_bytes <= 0 THEN 'empty file' WHEN width <= 0 OR height <= 0 THEN 'no picture' WHEN fps <= 0 THEN 'no frame rate' WHEN frame_count <= 0 THEN 'no frames' WHEN duration_ms < 1000 THEN 'too short' END AS reason FROM v_media", V_MEDIA)
def q2(spark, d):
    return q.media_reason(b.media(spark, d)).select("media_id", "reason")


@query("q3_frame_drift", "SELECT media_id, frame_count AS n_in, frame_count + media_id % 9 AS n_out FROM v_media WHERE media_id % 9 > 5", V_MEDIA)
def q3(spark, d):
    m = b.media(spark, d)
    return q.frame_drift(m, m.withColumn("frame_count", F.col("frame_count") + F.col("media_id") % 9))


@query("q4_zero_drift", "SELECT media_id, count(*) AS mismatches FROM v_cues WHERE ord % 20 = 0 GROUP BY media_id", V_CUES)
def q4(spark, d):
    from cuelake.operators.translate import compare

    raw = b.cues(spark, d)
    return compare(raw, raw.filter("ord % 20 <> 0")).groupBy("media_id").agg(F.count("*").alias("mismatches"))


@query("q6_over_long", "SELECT media_id, ord FROM v_cues WHERE end_ms - start_ms > 2000", V_CUES)
def q6(spark, d):
    return q.over_long(b.cues(spark, d), 2_000).select("media_id", "ord")


@query("q6_timecode_count", "SELECT media_id, count(*) * 2 AS n FROM v_cues GROUP BY media_id", V_CUES)
def q6b(spark, d):
    from cuelake.sources.subtitles import to_srt

    return to_srt(b.cues(spark, d)).select("media_id", q.timecode_count(F.col("document")).cast("bigint").alias("n"))


@query("q7_error_classes", "SELECT CASE event_id % 7 WHEN 0 THEN 'not_found' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'exhausted' WHEN 3 THEN 'exhausted' WHEN 4 THEN 'auth' ELSE 'other' END AS error, count(*) AS n FROM v_msg GROUP BY 1", V_MESSAGES)
def q7(spark, d):
    return b.messages(spark, d).groupBy(q.error_class(F.col("message")).alias("error")).agg(F.count("*").alias("n"))


@query("q8_retry_delay", "SELECT event_id, CASE event_id % 7 WHEN 2 THEN 17.5 WHEN 3 THEN 2 WHEN 6 THEN 60 ELSE 15 END::DOUBLE AS delay FROM v_msg", V_MESSAGES)
def q8(spark, d):
    return b.messages(spark, d).select("event_id", q.retry_delay(F.col("message")).alias("delay"))


@query("q7_error_texts", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)404|NOT_FOUND') THEN 'not_found' WHEN regexp_matches(text, '(?i)503|UNAVAILABLE') THEN 'unavailable' WHEN regexp_matches(text, '(?i)429|RESOURCE_EXHAUSTED|quota') THEN 'exhausted' WHEN regexp_matches(text, '(?i)401|auth') THEN 'auth' ELSE 'other' END AS error FROM documents")
def q7_texts(spark, d):
    """Whole texts as messages."""
    return b.table(spark, d, "documents").select("doc_id", q.error_class(F.col("text")).alias("error"))


@query("q8_retry_values", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(2.0, least(60.0, CAST(l_quantity AS DOUBLE) * CASE WHEN l_linenumber % 2 = 0 THEN 1.5 ELSE 0.25 END)) AS delay FROM lineitem")
def q8_values(spark, d):
    """Delays of every length, in both forms of the message."""
    li = b.table(spark, d, "lineitem")
    seconds = (F.col("l_quantity").cast("double") * F.when(F.col("l_linenumber") % 2 == 0, 1.5).otherwise(0.25)).cast("string")
    message = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("quota: 'retryDelay': '"), seconds, F.lit("s'"))).otherwise(F.concat(F.lit("Please RETRY in "), seconds, F.lit(" s.")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", q.retry_delay(message).alias("delay"))


@query("q9_latest_state", "SELECT job_id, arg_max(state, ts_ms * 100000000 + event_id) AS state, max(ts_ms) AS ts_ms, arg_max(state, ts_ms * 100000000 + event_id) IN ('COMPLETED', 'FAILED', 'CANCELLED') AS final FROM v_jobs GROUP BY job_id", V_CUES, V_JOBS)
def q9(spark, d):
    return q.latest_state(b.job_events(spark, d))


@query("q9_time_in_state", "SELECT job_id, state, coalesce(sum(nx - ts_ms), 0)::BIGINT AS in_state_ms FROM (SELECT *, lead(ts_ms) OVER (PARTITION BY job_id ORDER BY ts_ms, event_id) AS nx FROM v_jobs) z GROUP BY 1, 2", V_CUES, V_JOBS)
def q9b(spark, d):
    return q.time_in_state(b.job_events(spark, d))


LATEST = "lt AS (SELECT job_id, arg_max(state, ts_ms * 100000000 + event_id) AS state FROM v_jobs GROUP BY job_id)"


@query("a11_pool_summary", "SELECT count(*) FILTER (state <> 'FAILED') AS active, count(*) FILTER (state = 'FAILED') AS expired, count(*) AS total FROM lt", V_CUES, V_JOBS, LATEST)
def a11(spark, d):
    return q.pool_summary(b.job_events(spark, d), ["FAILED"])


@query("a12_batch_summary", "SELECT job_id % 10 AS batch, count(*) AS total, count(*) FILTER (state IN ('COMPLETED', 'FAILED', 'CANCELLED')) AS completed, count(*) FILTER (state = 'COMPLETED') AS success, count(*) FILTER (state = 'FAILED') AS failed FROM lt GROUP BY 1", V_CUES, V_JOBS, LATEST)
def a12(spark, d):
    return q.batch_summary(q.latest_state(b.job_events(spark, d)).withColumn("batch", F.col("job_id") % 10), ["batch"])


@query("q10_run_report", """SELECT job_id, '{"steps":[' || string_agg('{"state":"' || state || '","n":' || n || '}', ',' ORDER BY state, n) || '],"errors":' || coalesce(sum(n) FILTER (state = 'FAILED'), 0) || ',"elapsed_ms":' || (max(hi) - min(lo)) || '}' AS report
 FROM (SELECT job_id, state, count(*) AS n, max(ts_ms) AS hi, min(ts_ms) AS lo FROM v_jobs GROUP BY 1, 2) z GROUP BY job_id""", V_CUES, V_JOBS)
def q10(spark, d):
    return q.run_report(b.job_events(spark, d))


@query("q11_missing_outputs", "SELECT media_id FROM v_media WHERE media_id NOT IN (SELECT job_id FROM v_jobs WHERE state = 'COMPLETED')", V_MEDIA, V_CUES, V_JOBS)
def q11(spark, d):
    done = b.job_events(spark, d).filter("state = 'COMPLETED'").select(F.col("job_id").alias("media_id"))
    return q.missing_outputs(b.media(spark, d).select("media_id"), done, "media_id")


@query("s14_bounded_history", "SELECT media_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms DESC, ord DESC) AS n FROM v_cues) z WHERE n <= 5", V_CUES)
def s14(spark, d):
    return q.keep_latest(b.cues(spark, d), "media_id", [F.desc("start_ms"), F.desc("ord")], 5).select("media_id", "ord")


@query("w6_latest_n", "SELECT media_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY dur_ms DESC, ord) AS n FROM v_cues) z WHERE n <= 3", V_CUES)
def w6(spark, d):
    return q.keep_latest(b.cues(spark, d), "media_id", [F.desc("dur_ms"), F.col("ord")], 3).select("media_id", "ord")


@query("s18_log_rotation", """, s AS (SELECT source AS log, row_number() OVER (PARTITION BY source ORDER BY media_id, line_no) AS line_no, text FROM v_lines), z AS (SELECT log, sum(strlen(text) + 1) AS bytes FROM s GROUP BY log),
 r AS (SELECT s.*, bytes, row_number() OVER (PARTITION BY log ORDER BY line_no DESC) AS n FROM s JOIN z USING (log))
 SELECT log, line_no, text FROM r WHERE bytes <= 20000 OR n <= 50 UNION ALL SELECT log, -1, '--- rotated ---' FROM z WHERE bytes > 20000""".replace(", s AS", "WITH s AS", 1), V_LINES)
def s18(spark, d):
    from cuelake.operators.resume import numbered

    lines = b.lines(spark, d).select(F.col("source").alias("log"), "media_id", F.col("line_no").alias("at"), "text")
    return q.rotate_logs(numbered(lines, ["log"], ["media_id", "at"], "line_no").select("log", "line_no", "text"), 20_000, 50)


@query("u1_merge_strategy", """WITH o AS (SELECT *, max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, start_ms - end_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM v_cues),
 i AS (SELECT *, sum(CASE WHEN start_ms <= prev + 80 THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY start_ms, start_ms - end_ms, ord ROWS UNBOUNDED PRECEDING) AS island FROM o)
 SELECT media_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, first(text ORDER BY length(text) DESC, start_ms, start_ms - end_ms, ord) AS text FROM i GROUP BY media_id, island HAVING max(end_ms) - min(start_ms) > 50""", V_CUES)
def u1(spark, d):
    return folds.merge_by_strategy(b.cues(spark, d), "prefer_longest").select("media_id", "start_ms", "end_ms", "text")


#: The folds in SQL, a row of each medium after another. No two of the event types are alike
#: by ratio or hold one another, so that `alike` is equality here.
ISLANDS = """io AS (SELECT *, max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, start_ms - end_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM v_cues),
 isl AS (SELECT *, sum(CASE WHEN start_ms <= prev + 80 THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY start_ms, start_ms - end_ms, ord ROWS UNBOUNDED PRECEDING) AS island FROM io),
 inn AS (SELECT *, row_number() OVER (PARTITION BY media_id, island ORDER BY start_ms, start_ms - end_ms, ord) AS n FROM isl)"""
MERGED = """RECURSIVE WITH {islands},
 mf AS (SELECT media_id, island, n, ord, start_ms, end_ms, text FROM inn WHERE n = 1
 UNION ALL SELECT f.media_id, f.island, r.n, f.ord, f.start_ms, greatest(f.end_ms, r.end_ms), {text} FROM mf f JOIN inn r ON r.media_id = f.media_id AND r.island = f.island AND r.n = f.n + 1)
 SELECT media_id, ord, start_ms, end_ms, text FROM mf WHERE n = (SELECT max(n) FROM inn WHERE inn.media_id = mf.media_id AND inn.island = mf.island) AND end_ms - start_ms > 50"""


# the types share words only as a whole, and characters at their ends only exactly
BORDER = "list_max(list_filter(range(1, least(length(f.text), length(r.text)) + 1), lambda n: right(f.text, n) = left(r.text, n)))"


@query("t1_combine", MERGED.format(islands=ISLANDS, text=f"CASE WHEN contains(f.text, r.text) THEN f.text WHEN contains(r.text, f.text) THEN r.text ELSE f.text || coalesce(substr(r.text, CAST({BORDER} AS INTEGER) + 1), ' ' || r.text) END"), V_CUES)
def t1c(spark, d):
    return folds.merge_by_strategy(b.cues(spark, d), "combine")


@query("t1_prefer_first", MERGED.format(islands=ISLANDS, text="f.text"), V_CUES)
def t1f(spark, d):
    return folds.merge_by_strategy(b.cues(spark, d), "prefer_first")


DEDUPED = """RECURSIVE WITH nn AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, ord) AS n FROM v_cues),
 fd AS (SELECT media_id, n, 1 AS k, ord, start_ms, end_ms, text FROM nn WHERE n = 1
 UNION ALL SELECT r.media_id, r.n, CASE WHEN same THEN k ELSE k + 1 END, CASE WHEN same THEN f_ord ELSE r.ord END, CASE WHEN same THEN f_start ELSE r.start_ms END, CASE WHEN same THEN greatest(f_end, r.end_ms) ELSE r.end_ms END, r.text
 FROM (SELECT f.k, f.ord AS f_ord, f.start_ms AS f_start, f.end_ms AS f_end, r.*, r.start_ms - f.end_ms <= 1800 AND f.end_ms - f.start_ms < 8000 AND f.text = r.text AS same FROM fd f JOIN nn r ON r.media_id = f.media_id AND r.n = f.n + 1) r),
 dd AS (SELECT media_id, min(ord) AS ord, start_ms, max(end_ms) AS end_ms, any_value(text) AS text FROM (SELECT media_id, k, first(ord ORDER BY n) AS ord, first(start_ms ORDER BY n) AS start_ms, last(end_ms ORDER BY n) AS end_ms, first(text ORDER BY n) AS text FROM fd GROUP BY media_id, k) g GROUP BY media_id, k, start_ms)""".replace("media_id, k, start_ms)", "media_id, g.ord, start_ms)")


@query("t2_overlap_dedupe", DEDUPED + " SELECT * FROM dd", V_CUES)
def t2(spark, d):
    return folds.dedupe_overlap(b.cues(spark, d)).drop("x", "y", "w", "h")


def boxed_sample():
    """Text, medium length and box of a sample, from the text and ord of a cue."""
    box = {"x": F.col("ord") % 600, "y": F.col("ord") % 300, "w": F.col("ord") % 50 + 10, "h": F.col("ord") % 20 + 5}
    return [F.when(F.col("text") == "view", F.lit("")).otherwise(F.col("text")).alias("text"), F.lit(10_000_000).cast("bigint").alias("duration_ms"),
            *[F.when(F.col("ord") % 7 > 0, v).cast("int").alias(k) for k, v in box.items()]]


def frames(spark, d):
    return b.cues(spark, d).select("media_id", "ord", F.col("start_ms").alias("t_ms"), *boxed_sample())


#: hull: union of two boxes (x0, y0, x1, y1), either of which may be null.
SAMPLED = """RECURSIVE WITH nn AS (SELECT media_id, ord, start_ms AS t, CASE WHEN text = 'view' THEN '' ELSE text END AS text, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, ord) AS n,
 CASE WHEN ord % 7 > 0 THEN ord % 600 END AS x0, CASE WHEN ord % 7 > 0 THEN ord % 300 END AS y0, CASE WHEN ord % 7 > 0 THEN ord % 600 + ord % 50 + 10 END AS x1, CASE WHEN ord % 7 > 0 THEN ord % 300 + ord % 20 + 5 END AS y1 FROM v_cues),
 fs AS (SELECT media_id, n, text <> '' AS op, ord, t AS s, t + 1500 AS e, text, t AS seen, x0, y0, x1, y1 FROM nn WHERE n = 1
 UNION ALL SELECT media_id, n, CASE WHEN text = '' THEN recent ELSE true END,
 CASE WHEN keep THEN f_ord ELSE ord END, CASE WHEN keep THEN s ELSE t END, t + 1500, CASE WHEN keep THEN f_text ELSE text END, CASE WHEN text = '' THEN seen ELSE t END,
 CASE WHEN text = '' THEN f0 WHEN keep THEN least(f0, x0) ELSE x0 END, CASE WHEN text = '' THEN f1 WHEN keep THEN least(f1, y0) ELSE y0 END, CASE WHEN text = '' THEN f2 WHEN keep THEN greatest(f2, x1) ELSE x1 END, CASE WHEN text = '' THEN f3 WHEN keep THEN greatest(f3, y1) ELSE y1 END
 FROM (SELECT q.*, recent AND (text = '' OR text = f_text) AS keep FROM (SELECT r.*, f.ord AS f_ord, f.s, f.text AS f_text, f.seen, f.x0 AS f0, f.y0 AS f1, f.x1 AS f2, f.y1 AS f3, f.op AND r.t - f.seen <= 6000 AND r.t - f.s < 8000 AS recent FROM fs f JOIN nn r ON r.media_id = f.media_id AND r.n = f.n + 1) q) r),
 sc AS (SELECT media_id, ord, s AS start_ms, max(e) AS end_ms, any_value(text) AS text, CAST(last(x0 ORDER BY n) AS INTEGER) AS x, CAST(last(y0 ORDER BY n) AS INTEGER) AS y, CAST(last(x1 ORDER BY n) - last(x0 ORDER BY n) AS INTEGER) AS w, CAST(last(y1 ORDER BY n) - last(y0 ORDER BY n) AS INTEGER) AS h FROM fs WHERE op GROUP BY media_id, ord, s)"""


@query("t3_sampled_cues", SAMPLED + " SELECT * FROM sc WHERE end_ms - start_ms >= CASE WHEN length(text) >= 4 THEN 180 ELSE 300 END", V_CUES)
def t3(spark, d):
    return folds.sampled_cues(frames(spark, d), miss_ms=6_000)


@query("t5_consecutive_similar", """WITH nn AS (SELECT *, lag(text) OVER (PARTITION BY media_id ORDER BY start_ms, ord) AS prev FROM v_cues),
 r AS (SELECT *, sum(CASE WHEN text = prev THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY start_ms, ord ROWS UNBOUNDED PRECEDING) AS k FROM nn)
 SELECT media_id, first(ord ORDER BY start_ms, ord) AS ord, min(start_ms) AS start_ms, max(start_ms) + 1500 AS end_ms, any_value(text) AS text FROM r WHERE text <> 'view' GROUP BY media_id, k""", V_CUES)
def t5(spark, d):
    return folds.consecutive_similar(frames(spark, d))


@query("t4_consecutive_either", """RECURSIVE WITH nn AS (SELECT *, text[1:1] AS trans, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, ord) AS n FROM v_cues),
 f AS (SELECT media_id, n, ord AS o, text AS ft, trans AS fr, start_ms AS t, start_ms AS e FROM nn WHERE n = 1
 UNION ALL SELECT r.media_id, r.n, CASE WHEN same THEN o ELSE ord END, CASE WHEN same THEN ft ELSE text END, CASE WHEN same THEN fr ELSE trans END, CASE WHEN same THEN t ELSE start_ms END, start_ms
 FROM (SELECT r.*, f.o, f.ft, f.fr, f.t, f.ft = r.text OR f.fr = r.trans AS same FROM f JOIN nn r ON r.media_id = f.media_id AND r.n = f.n + 1) r)
 SELECT media_id, o AS ord, greatest(t - 200, 0) AS start_ms, max(e) + 1500 AS end_ms, fr AS text, CASE WHEN o % 7 > 0 THEN CAST(o % 600 AS INTEGER) END AS x FROM f GROUP BY media_id, o, t, fr""", V_CUES)
def t4b(spark, d):
    # event types that begin with one letter count as one translation
    rows = b.cues(spark, d).select("media_id", "ord", F.col("start_ms").alias("t_ms"), "text", F.substring("text", 1, 1).alias("trans"), *boxed_sample()[2:])
    return folds.consecutive_either(rows).drop("y", "w", "h")


@query("q5_residual_duplicates", DEDUPED + """ SELECT media_id, ord, text, next_text, 1.0::DOUBLE AS ratio FROM (SELECT *, lead(text) OVER w AS next_text, lead(start_ms) OVER w AS next_start FROM dd WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, ord)) z
 WHERE next_start - end_ms <= 2500 AND text = next_text AND length(text) > 2""", V_CUES)
def q5(spark, d):
    return folds.residual_duplicates(folds.dedupe_overlap(b.cues(spark, d)))


@query("x2_similarity")
def x2(spark, d):
    from pyspark.sql import Window as W

    from cuelake.functions.similarity import similarity

    # dealt by medium before the window: tasks hold like shares of the comparing, however small their bytes
    lines = b.dealt(b.lines(spark, d), "media_id")
    pairs = lines.withColumn("next", F.lead("text").over(W.partitionBy("media_id").orderBy("line_no"))).filter("next IS NOT NULL")
    return pairs.select("media_id", "line_no", similarity(F.lower("text"), F.lower("next")).alias("ratio"))


@query("x4_overlap_merge")
def x4(spark, d):
    from pyspark.sql import Window as W

    from cuelake.functions.similarity import overlap_merged

    turn = b.dealt(b.turns(spark, d).select("conv_id", "turn", "text"), "conv_id").withColumn("next", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).filter("next IS NOT NULL")
    return turn.withColumn("merged", overlap_merged("text", "next")).select("conv_id", "turn", F.length("merged").alias("n"), "merged")


@query("u2_registered_functions", "SELECT doc_id, CASE WHEN starts_with(source, 'src') THEN 6 / (length(source) + 3) END AS ratio, 'a ' || source || ' b' AS merged FROM documents")
def u2(spark, d):
    from cuelake.functions.similarity import register

    register(spark)
    b.table(spark, d, "documents").createOrReplaceTempView("cuelake_documents")
    return spark.sql("SELECT doc_id, similarity(source, 'src') AS ratio, overlap_merge('a ' || source, source || ' b') AS merged FROM cuelake_documents")


@query("u3_aggregate_expressions", "SELECT frame, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, CAST(round(1000 * max(CASE text WHEN ' ' THEN 0 WHEN ',' THEN 0 ELSE 2 + conf_pct / 100 * 12 END)) AS BIGINT) AS score FROM v_det GROUP BY frame", V_DETECTIONS)
def u3(spark, d):
    from cuelake.operators.detections import best_score, box_union

    v = b.detections(spark, d).withColumn("box", F.struct("x", "y", "w", "h"))
    both = v.groupBy("frame").agg(box_union(F.col("box")).alias("box"), best_score(F.col("text"), F.col("conf_pct") / 100).alias("score"))
    return both.select("frame", "box.*", F.round(F.col("score") * 1000).cast("bigint").alias("score"))
