"""Queries over cues, with their SQL."""
from pyspark.sql import functions as F

from cuelake.operators import cues as c
from cuelake.plans import bindings as b
from cuelake.plans.bindings import V_CUES, V_LINES, V_MEDIA
from cuelake.plans.registry import query

ISLANDS = """isl AS (SELECT *, sum(CASE WHEN start_ms <= prev + 80 THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY start_ms, start_ms - end_ms, ord ROWS UNBOUNDED PRECEDING) AS island
 FROM (SELECT *, max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, start_ms - end_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM v_cues) z)"""
MERGED = """m AS (SELECT media_id, island, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
 first(text ORDER BY length(text) DESC, start_ms, start_ms - end_ms, ord) AS text, count(*) AS n_cues FROM isl GROUP BY media_id, island)"""


@query("t1_merge_islands", "SELECT media_id, CAST(island AS BIGINT) AS island, start_ms, end_ms, trim(text) AS text, n_cues FROM m WHERE trim(text) <> '' AND end_ms - start_ms > 50", V_CUES, ISLANDS, MERGED)
def t1(spark, d):
    return c.merge_islands(b.cues(spark, d))


@query("a13_run_digest", "SELECT media_id, count(*) AS n_cues, sum(end_ms - start_ms) AS covered_ms, max(end_ms) AS last_ms FROM m WHERE trim(text) <> '' AND end_ms - start_ms > 50 GROUP BY media_id", V_CUES, ISLANDS, MERGED)
def a13(spark, d):
    return c.merge_islands(b.cues(spark, d)).groupBy("media_id").agg(F.count("*").alias("n_cues"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"), F.max("end_ms").alias("last_ms"))


@query("w1_running_max_island", "SELECT media_id, ord, CAST(island AS BIGINT) AS island FROM isl", V_CUES, ISLANDS)
def w1(spark, d):
    return c.with_islands(b.cues(spark, d), 80).select("media_id", "ord", "island")


@query("t16_normalize_cues", "SELECT media_id, ord, start_ms, end_ms, text, 1.0::DOUBLE AS confidence FROM v_cues WHERE trim(text) <> ''", V_CUES)
def t16(spark, d):
    return c.normalize_cues(b.cues(spark, d)).drop("bbox")


@query("p1_parse_timecode", "SELECT ord, start_ms AS ms FROM v_cues", V_CUES)
def p1(spark, d):
    from cuelake.functions.time import parse_timecode, srt_time

    return b.cues(spark, d).select("ord", parse_timecode(srt_time(F.col("start_ms"))).alias("ms"))


HMS = "lpad(CAST(t // 3600000 AS VARCHAR), greatest(2, length(CAST(t // 3600000 AS VARCHAR)))::INTEGER, '0') || ':' || lpad(CAST(t // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(t % 1000 AS VARCHAR), 3, '0')"


@query("p2_srt_time", f"SELECT ord, {HMS} AS code FROM (SELECT ord, greatest(start_ms - 500000, 0) AS t FROM v_cues) q", V_CUES)
def p2(spark, d):
    from cuelake.functions.time import srt_time

    return b.cues(spark, d).select("ord", srt_time(F.col("start_ms") - 500_000).alias("code"))


@query("p3_srt_time_clamped", f"SELECT ord, {HMS} AS code FROM (SELECT ord, start_ms + 0 AS t FROM v_cues) q", V_CUES)
def p3(spark, d):
    from cuelake.functions.time import srt_time_clamped

    return b.cues(spark, d).select("ord", srt_time_clamped(F.col("start_ms") / 1000).alias("code"))


@query("p4_ass_time", """SELECT ord, CAST(t // 360000 AS VARCHAR) || ':' || lpad(CAST(t // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(t % 100 AS VARCHAR), 2, '0') AS code
 FROM (SELECT ord, CASE WHEN start_ms % 10 > 5 OR (start_ms % 10 = 5 AND start_ms // 10 % 2 = 1) THEN start_ms // 10 + 1 ELSE start_ms // 10 END AS t FROM v_cues) q""", V_CUES)
def p4(spark, d):
    from cuelake.functions.time import ass_time

    return b.cues(spark, d).select("ord", ass_time(F.col("start_ms")).alias("code"))


@query("p5_short_noise", "SELECT media_id, line_no, text FROM v_lines WHERE length(trim(text)) >= 2 OR regexp_matches(text, '[一-鿿　-〿＀-￯]')", V_LINES)
def p5(spark, d):
    return c.drop_short_noise(b.lines(spark, d)).select("media_id", "line_no", "text")


@query("p6_min_duration", "SELECT media_id, ord, text FROM v_cues WHERE end_ms - start_ms >= CASE WHEN length(trim(text)) >= 4 THEN 180 ELSE 300 END", V_CUES)
def p6(spark, d):
    return c.drop_brief(b.cues(spark, d)).select("media_id", "ord", "text")


@query("p7_degenerate", "SELECT media_id, ord FROM v_cues WHERE trim(text) <> '' AND end_ms - start_ms > 50", V_CUES)
def p7(spark, d):
    return c.drop_degenerate(b.cues(spark, d)).select("media_id", "ord")


PLACED = "v_placed AS (SELECT media_id, ord, start_ms, end_ms, CASE ord % 9 WHEN 0 THEN '[Gemini] ' || text WHEN 1 THEN '[Lỗi 5]' ELSE text END AS text FROM v_cues)"


def placed(spark, d):
    t = F.when(F.col("ord") % 9 == 0, F.concat(F.lit("[Gemini] "), "text")).when(F.col("ord") % 9 == 1, F.lit("[Lỗi 5]")).otherwise(F.col("text"))
    return b.cues(spark, d).withColumn("text", t)


@query("p8_placeholder", "SELECT media_id, ord, text FROM v_placed WHERE NOT (contains(text, '[Chữ khó') OR contains(text, '[Gemini]') OR contains(text, '[Unreadable]') OR contains(text, '[Lỗi'))", V_CUES, PLACED)
def p8(spark, d):
    return placed(spark, d).filter(~c.is_placeholder(F.col("text"))).select("media_id", "ord", "text")


@query("p17_field_search", """SELECT conv_id AS media_id, count(*) FILTER (contains(lower(text), 'the')) AS hits_text, count(*) FILTER (contains(lower(role), 'the')) AS hits_role,
 count(*) FILTER (contains(lower(text), 'the') OR contains(lower(role), 'the')) AS hits_all FROM conversations GROUP BY 1""")
def p17(spark, d):
    return c.search(b.turns(spark, d).withColumnRenamed("conv_id", "media_id"), "the", ["text", "role"])


GROUPS = """g AS (SELECT *, sum(CASE WHEN start_ms - prev < 1000 THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY start_ms, ord ROWS UNBOUNDED PRECEDING) AS grp
 FROM (SELECT *, lag(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, ord) AS prev FROM v_cues) z)"""


@query("t6_gap_groups", "SELECT media_id, CAST(grp AS BIGINT) AS grp, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM g GROUP BY 1, 2", V_CUES, GROUPS)
def t6(spark, d):
    return c.group_by_gap(b.cues(spark, d)).groupBy("media_id", "grp").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


@query("w2_previous_gap", "SELECT media_id, ord, start_ms - lag(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, ord) AS gap_ms FROM v_cues", V_CUES)
def w2(spark, d):
    return b.cues(spark, d).select("media_id", "ord", (F.col("start_ms") - F.lag("end_ms").over(c.media_order("start_ms", "ord"))).alias("gap_ms"))


PROBES = """p AS (SELECT media_id, grp, probe, CASE probe WHEN 0 THEN s + (e - s) * 5 // 10 WHEN 1 THEN s + (e - s) * 2 // 10 ELSE s + (e - s) * 8 // 10 END AS t_ms
 FROM (SELECT media_id, grp, min(start_ms) AS s, max(end_ms) AS e FROM g GROUP BY 1, 2) q, (VALUES (0), (1), (2)) v(probe) WHERE probe = 0 OR e - s > 500)"""


@query("t7_probe_choice", """, c AS (SELECT *, (t_ms * 7 + grp) % 61 AS conf FROM p),
 k AS (SELECT media_id, grp, max(conf) FILTER (probe = 0) AS c0, max(conf) FILTER (probe = 1) AS c1, max(conf) FILTER (probe = 2) AS c2 FROM c GROUP BY 1, 2),
 r AS (SELECT media_id, grp, CASE WHEN c0 >= 30 OR c1 IS NULL THEN 0 WHEN c1 >= 30 THEN CASE WHEN c1 > c0 THEN 1 ELSE 0 END
  WHEN c2 > greatest(c0, c1) THEN 2 WHEN c1 > c0 THEN 1 ELSE 0 END AS probe, c0, c1, c2 FROM k)
 SELECT g.media_id, g.ord, r.probe, CASE r.probe WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS conf_pct FROM g JOIN r USING (media_id, grp)""".replace(", c AS", "WITH c AS", 1), V_CUES, GROUPS, PROBES)
def t7(spark, d):
    cues = b.cues(spark, d)
    probes = c.probe_schedule(cues).withColumn("conf_pct", (F.col("t_ms") * 7 + F.col("grp")) % 61)
    return c.group_by_gap(cues).join(c.best_probe(probes).hint("merge"), ["media_id", "grp"]).select("media_id", "ord", "probe", "conf_pct")


CHUNKS = """ch AS (SELECT media_id, CAST(i AS INTEGER) AS chunk_idx, i * 20000 AS start_ms, least(21500, duration_ms - i * 20000) AS dur_ms, duration_ms
 FROM (SELECT media_id, duration_ms, unnest(range(greatest(1, (duration_ms - 1) // 20000 + CASE WHEN (duration_ms - 1) // 20000 > 0 AND duration_ms - (duration_ms - 1) // 20000 * 20000 < 1000 THEN 0 ELSE 1 END))) AS i FROM v_media) q)"""


@query("t8_chunk_plan", "SELECT media_id, chunk_idx, start_ms, dur_ms FROM ch", V_MEDIA, CHUNKS)
def t8(spark, d):
    return c.chunk_plan(b.media(spark, d))


@query("t9_resume_plan", """, f AS (SELECT *, CASE WHEN media_id % 4 = 0 THEN 0 ELSE media_id % 6 * 5000 END AS from_ms, CASE WHEN media_id % 4 = 0 THEN 0 ELSE media_id % 3 END AS had FROM v_media),
 r AS (SELECT *, from_ms + k * 20000 AS start_ms FROM (SELECT *, unnest(range((duration_ms - from_ms + 19999) // 20000)) AS k FROM f WHERE from_ms < duration_ms) q)
 SELECT media_id, start_ms // 20000 AS chunk_idx, start_ms, least(21500, duration_ms - start_ms) AS dur_ms FROM r WHERE NOT (duration_ms - start_ms < 1000 AND (had > 0 OR k > 0))""".replace(", f AS", "WITH f AS", 1), V_MEDIA)
def t9(spark, d):
    m = b.media(spark, d)
    points = m.select("media_id", F.when(F.col("media_id") % 4 == 0, F.lit("other.mp4")).otherwise(F.col("path")).alias("path"), (F.col("media_id") % 6 * 5000).alias("done_ms"), (F.col("media_id") % 3).alias("n_cues"))
    return c.resume_plan(m, points)


CHUNKED = "cc AS (SELECT media_id, ord, CAST(ord % 3 AS INTEGER) AS chunk_idx, start_ms % 20000 AS start_ms, start_ms % 20000 + dur_ms AS end_ms FROM v_cues)"


def chunked(spark, d):
    cues = b.cues(spark, d)
    return cues.withColumns({"chunk_idx": (F.col("ord") % 3).cast("int"), "start_ms": F.col("start_ms") % 20_000, "end_ms": F.col("start_ms") % 20_000 + F.col("dur_ms")})


@query("j5_chunk_offset", "SELECT media_id, ord, cc.start_ms + ch.start_ms AS start_ms, cc.end_ms + ch.start_ms AS end_ms FROM cc JOIN ch USING (media_id, chunk_idx)", V_CUES, V_MEDIA, CHUNKS, CHUNKED)
def j5(spark, d):
    return c.shift_by_chunk(chunked(spark, d), c.chunk_plan(b.media(spark, d))).select("media_id", "ord", "start_ms", "end_ms")


@query("t10_reassemble", "SELECT ch.media_id, ch.chunk_idx, ch.start_ms, count(cc.ord) AS n_cues FROM ch LEFT JOIN cc USING (media_id, chunk_idx) GROUP BY 1, 2, 3", V_CUES, V_MEDIA, CHUNKS, CHUNKED)
def t10(spark, d):
    return c.reassemble(c.chunk_plan(b.media(spark, d)), chunked(spark, d))


@query("t11_retime_with_silence", """SELECT media_id, line_no AS ord, coalesce(sum(d + 350) OVER w, 0)::BIGINT AS start_ms, coalesce(sum(d + 350) OVER w, 0)::BIGINT + d AS end_ms
 FROM (SELECT media_id, line_no, CASE WHEN length(text) % 5 = 0 THEN 2500 ELSE length(text) * 40 END AS d FROM v_lines WHERE trim(text) <> '') q WINDOW w AS (PARTITION BY media_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", V_LINES)
def t11(spark, d):
    rows = b.lines(spark, d).select("media_id", F.col("line_no").alias("ord"), "text", F.when(F.length("text") % 5 == 0, 0).otherwise(F.length("text") * 40).cast("bigint").alias("dur_ms"))
    return c.lay_out(rows).select("media_id", "ord", "start_ms", "end_ms")


@query("w3_running_clock", "SELECT media_id, ord, coalesce(sum(dur_ms) OVER (PARTITION BY media_id ORDER BY start_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS clock_ms FROM v_cues", V_CUES)
def w3(spark, d):
    w = c.media_order("start_ms", "ord").rowsBetween(*c.BEFORE)
    return b.cues(spark, d).select("media_id", "ord", F.coalesce(F.sum("dur_ms").over(w), F.lit(0)).cast("bigint").alias("clock_ms"))


@query("t12_speech_fit", """SELECT media_id, ord, round(f, 9) AS factor, abs(f - 1) < 0.05 AS copy, CASE WHEN abs(f - 1) < 0.05 THEN 0 ELSE n + 1 END AS links,
 CASE WHEN abs(f - 1) < 0.05 THEN NULL ELSE CAST(round(f / pow(2, n), 4) * 10000 AS BIGINT) END AS rest_1e4
 FROM (SELECT *, CASE WHEN f <= 2 THEN 0 WHEN f <= 4 THEN 1 WHEN f <= 8 THEN 2 WHEN f <= 16 THEN 3 WHEN f <= 32 THEN 4 WHEN f <= 64 THEN 5 WHEN f <= 128 THEN 6 WHEN f <= 256 THEN 7 WHEN f <= 512 THEN 8 WHEN f <= 1024 THEN 9 WHEN f <= 2048 THEN 10 WHEN f <= 4096 THEN 11 WHEN f <= 8192 THEN 12 ELSE 13 END AS n
 FROM (SELECT media_id, ord, CASE WHEN clip_ms / dur_ms > 1.05 THEN clip_ms / dur_ms ELSE 1.0 END::DOUBLE AS f FROM (SELECT *, (ord % 7 * 900 + 1)::DOUBLE AS clip_ms FROM v_cues WHERE dur_ms > 0) a) b) q""", V_CUES)
def t12(spark, d):
    cues = b.cues(spark, d)
    fit = c.speech_fit(cues, cues.select("media_id", "ord", (F.col("ord") % 7 * 900 + 1).alias("clip_ms")))
    return fit.select("media_id", "ord", F.round("factor", 9).alias("factor"), "copy", F.size("chain").alias("links"), F.when(F.size("chain") > 0, F.round(F.get(F.col("chain"), F.size("chain") - 1) * 10_000).cast("bigint")).alias("rest_1e4"))


@query("t13_masked_timeline", """, s AS (SELECT media_id, line_no AS ord, regexp_replace(text, '(an|on)', '**', 'g') AS text FROM v_lines),
 p AS (SELECT media_id, ord, unnest(regexp_extract_all(text, '\\*+|[^*]+')) AS piece, CAST(unnest(range(len(regexp_extract_all(text, '\\*+|[^*]+')))) AS INTEGER) AS part FROM s),
 k AS (SELECT *, CASE WHEN piece LIKE '*%' THEN 'tone' WHEN regexp_matches(piece, '^[ \\n\\t,.!?]*$') THEN 'silence' ELSE 'speech' END AS kind FROM p),
 l AS (SELECT *, CASE kind WHEN 'tone' THEN 400 WHEN 'silence' THEN length(piece) * 50 ELSE 300 END::BIGINT AS dur_ms FROM k)
 SELECT media_id, ord, part, kind, dur_ms, coalesce(sum(dur_ms) OVER (PARTITION BY media_id, ord ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM l""".replace(", s AS", "WITH s AS", 1), V_LINES)
def t13(spark, d):
    rows = b.lines(spark, d).select("media_id", F.col("line_no").alias("ord"), F.regexp_replace("text", "(an|on)", "**").alias("text"))
    return c.masked_timeline(rows)


@query("t14_leading_gap", "SELECT media_id, start_ms, end_ms, text FROM v_cues UNION ALL SELECT media_id, 0, min(start_ms), '' FROM v_cues GROUP BY media_id HAVING min(start_ms) > 1000", V_CUES)
def t14(spark, d):
    return c.fill_leading_gap(b.cues(spark, d))


@query("t15_edits", """, n AS (SELECT *, CASE ord % 10 WHEN 1 THEN 'split' WHEN 4 THEN 'merge' WHEN 7 THEN 'move' END AS action FROM v_cues),
 e AS (SELECT *, lead(end_ms) OVER w AS n_end, lead(text) OVER w AS n_text, lag(action) OVER w AS before FROM n WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, ord)),
 k AS (SELECT * FROM e WHERE before IS NULL OR before <> 'merge')
 SELECT media_id, ord, 0 AS part, CASE WHEN action = 'move' AND ord % 20 = 7 THEN start_ms + 5 ELSE start_ms END AS start_ms,
  CASE WHEN action = 'split' THEN (start_ms + end_ms) // 2 WHEN action = 'merge' AND n_end IS NOT NULL THEN greatest(end_ms, n_end) WHEN action = 'move' AND ord % 20 = 7 THEN start_ms + 105 ELSE end_ms END AS end_ms,
  CASE WHEN action = 'merge' AND n_end IS NOT NULL THEN text || ' ' || n_text ELSE text END AS text FROM k
 UNION ALL SELECT media_id, ord, 1, (start_ms + end_ms) // 2, end_ms, text FROM k WHERE action = 'split'""".replace(", n AS", "WITH n AS", 1), V_CUES)
def t15(spark, d):
    cues = b.cues(spark, d).select("media_id", "ord", "start_ms", "end_ms", "text")
    o = F.col("ord")
    action = F.when(o % 10 == 1, "split").when(o % 10 == 4, "merge").when(o % 10 == 7, "move")
    edits = cues.withColumn("action", action).filter("action IS NOT NULL").select("media_id", "ord", "action", F.when(o % 20 == 7, F.col("start_ms") + 5).otherwise(F.lit(9)).alias("start_ms"), F.when(o % 20 == 7, F.col("start_ms") + 105).otherwise(F.lit(9)).alias("end_ms"))
    return c.apply_edits(cues, edits)


FRAMES = "fr AS (SELECT ord AS frame_no, media_id, start_ms + ord % 50 * 20 AS t_ms FROM v_cues)"


def frames(spark, d):
    return b.cues(spark, d).select("media_id", F.col("ord").alias("frame_no"), (F.col("start_ms") + F.col("ord") % 50 * 20).alias("t_ms"))


ACTIVE = """j AS (SELECT f.media_id, f.frame_no, f.t_ms, x.ord, x.text FROM fr f LEFT JOIN (
 SELECT f.media_id, f.frame_no, first(p.ord ORDER BY p.start_ms, p.ord) AS ord, first(p.text ORDER BY p.start_ms, p.ord) AS text FROM fr f JOIN v_placed p
 ON p.media_id = f.media_id AND p.start_ms <= f.t_ms AND f.t_ms <= p.end_ms AND NOT (contains(p.text, '[Gemini]') OR contains(p.text, '[Lỗi')) GROUP BY 1, 2) x USING (media_id, frame_no))"""


@query("j4_active_cue", "SELECT * FROM j", V_CUES, PLACED, FRAMES, ACTIVE)
def j4(spark, d):
    return c.active_cue(frames(spark, d), placed(spark, d))


@query("a9_rendered_frames", "SELECT media_id, count(ord) AS rendered, count(*) AS frames, coalesce(len(list(DISTINCT text ORDER BY text) FILTER (length(text) > 5)), 0) AS overflowing FROM j GROUP BY media_id", V_CUES, PLACED, FRAMES, ACTIVE)
def a9(spark, d):
    return c.active_cue(frames(spark, d), placed(spark, d)).groupBy("media_id").agg(F.count("ord").alias("rendered"), F.count("*").alias("frames"), F.count_distinct(F.when(F.length("text") > 5, F.col("text"))).alias("overflowing"))


@query("t4_consecutive_equal", """, r AS (SELECT *, sum(CASE WHEN prev = text THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY start_ms, ord ROWS UNBOUNDED PRECEDING) AS run
 FROM (SELECT *, lag(text) OVER (PARTITION BY media_id ORDER BY start_ms, ord) AS prev FROM v_cues) z)
 SELECT media_id, CAST(run AS BIGINT) AS run, greatest(min(start_ms) - 200, 0) AS start_ms, max(start_ms) + 1500 AS end_ms, min(text) AS text, count(*) AS n FROM r GROUP BY 1, 2""".replace(", r AS", "WITH r AS", 1), V_CUES)
def t4(spark, d):
    return c.consecutive_equal(b.cues(spark, d).select("media_id", "ord", F.col("start_ms").alias("t_ms"), "text"))


@query("w5_stable_sort", "SELECT media_id, ord, row_number() OVER (PARTITION BY media_id ORDER BY length(text) DESC, start_ms, ord)::INTEGER AS nth FROM v_cues", V_CUES)
def w5(spark, d):
    return b.cues(spark, d).select("media_id", "ord", F.row_number().over(c.media_order(F.desc(F.length("text")), "start_ms", "ord")).alias("nth"))


@query("o1_union_cues", "SELECT text, count(*) AS n FROM (SELECT text FROM v_cues UNION ALL SELECT text FROM v_lines) u GROUP BY text", V_CUES, V_LINES)
def o1(spark, d):
    return b.cues(spark, d).select("text").unionByName(b.lines(spark, d).select("text")).groupBy("text").agg(F.count("*").alias("n"))


@query("o2_first_distinct", "SELECT media_id, text, min(ord) AS first_ord FROM v_cues GROUP BY 1, 2", V_CUES)
def o2(spark, d):
    return b.cues(spark, d).groupBy("media_id", "text").agg(F.min("ord").alias("first_ord"))


@query("o4_distinct_insert", "SELECT DISTINCT text FROM v_lines WHERE trim(text) <> ''", V_LINES)
def o4(spark, d):
    return b.lines(spark, d).filter(F.trim("text") != "").select("text").dropDuplicates(["text"])


@query("s4_srt_sink", f"""SELECT media_id, string_agg(n || chr(10) || {HMS.replace('t //', 'start_ms //').replace('(t %', '(start_ms %')} || ' --> ' || {HMS.replace('t //', 'end_ms //').replace('(t %', '(end_ms %')} || chr(10) || text || chr(10), chr(10) ORDER BY n) AS document
 FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, ord) AS n FROM v_cues) q GROUP BY media_id""", V_CUES)
def s4(spark, d):
    from cuelake.sources.subtitles import to_srt

    return to_srt(b.cues(spark, d))
