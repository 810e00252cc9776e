"""Queries over detections, with their SQL."""
from pyspark.sql import functions as F

from cuelake.operators import detections as det
from cuelake.plans import bindings as b
from cuelake.plans.bindings import V_DETECTIONS
from cuelake.plans.registry import query


def boxes(spark, d):
    v = b.detections(spark, d)
    return v.withColumns({"conf": F.col("conf_pct") / 100, "pts": det.rectangle(F.col("x"), F.col("y"), F.col("w"), F.col("h"))})


@query("p9_noise_filter", "SELECT frame, ord, text FROM v_det WHERE trim(text) <> '' AND conf_pct >= 15 AND NOT (text = ',' AND conf_pct < 45)", V_DETECTIONS)
def p9(spark, d):
    return det.filter_noise(boxes(spark, d)).select("frame", "ord", "text")


@query("p9_force_scan", """, f AS (SELECT o_orderkey AS frame FROM orders UNION SELECT -o_orderkey FROM orders), k AS (SELECT * FROM v_det)
 SELECT f.frame, coalesce(k.ord, 0) AS ord, CASE WHEN k.ord IS NULL OR conf_pct < 15 THEN '[Chữ khó - Nhấp quét Gemini]' ELSE text END AS text, CAST(coalesce(conf_pct, 10) AS INTEGER) AS conf_pct
 FROM f LEFT JOIN k USING (frame)""".replace(", f AS", "WITH f AS", 1), V_DETECTIONS)
def p9b(spark, d):
    key = F.col("o_orderkey")
    frames = b.table(spark, d, "orders").select(F.explode(F.array(key, -key)).alias("frame"))  # nothing is detected on the second
    return det.force_scan(frames, boxes(spark, d)).select("frame", "ord", "text", F.round(F.col("conf") * 100).cast("int").alias("conf_pct"))


@query("p10_confidence_gates", "SELECT frame, count(*) FILTER (conf_pct >= 45) AS n45, count(*) FILTER (conf_pct > 45) AS over45, count(*) FILTER (conf_pct >= 50) AS n50, count(*) FILTER (conf_pct > 20) AS over20 FROM v_det GROUP BY frame", V_DETECTIONS)
def p10(spark, d):
    v = boxes(spark, d)
    n = lambda df, name: df.groupBy("frame").agg(F.count("*").alias(name))
    out = v.select("frame").distinct()
    for least, strict, name in ((0.45, False, "n45"), (0.45, True, "over45"), (0.5, False, "n50"), (0.2, True, "over20")):
        out = out.join(n(det.gate(v, least, strict=strict), name), "frame", "left")
    return out.na.fill(0)


@query("p11_rescale", "SELECT frame, ord, x / 2.0::DOUBLE AS x, y / 4.0::DOUBLE AS y FROM v_det", V_DETECTIONS)
def p11(spark, d):
    p = F.get(F.col("pts"), F.lit(0))
    return det.rescale(boxes(spark, d), 2.0, 4.0).select("frame", "ord", p["x"].alias("x"), p["y"].alias("y"))


@query("p12_vision_boxes", """SELECT frame, ord, text, x * 640 // 1000 AS x, y * 360 // 1000 AS y, greatest(10, (x + w) * 640 // 1000 - x * 640 // 1000) AS w, greatest(10, (y + h) * 360 // 1000 - y * 360 // 1000) AS h
 FROM (SELECT frame, text, x, y, w, h, CAST(row_number() OVER (PARTITION BY frame ORDER BY ord) - 1 AS INTEGER) AS ord FROM v_det) q WHERE trim(text) <> ''""", V_DETECTIONS)
def p12(spark, d):
    item = F.struct("ord", F.col("text").alias("original_text"), F.lit("t").alias("translated_text"), F.array(F.col("y"), F.col("x"), F.col("y") + F.col("h"), F.col("x") + F.col("w")).alias("box_2d"))
    answers = boxes(spark, d).groupBy("frame").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("json")).withColumns({"width": F.lit(640), "height": F.lit(360)})
    return det.vision_items(answers).select("frame", "ord", F.col("original_text").alias("text"), "bbox.*")


CLAMPED = "SELECT frame, ord, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM (SELECT frame, ord, greatest(0, least({x}, {W})) AS x1, greatest(0, least({y}, {H})) AS y1, greatest(0, least({x} + w, {W})) AS x2, greatest(0, least({y} + h, {H})) AS y2 FROM v_det) q WHERE x2 > x1 AND y2 > y1"


@query("p13_clamp", CLAMPED.format(x="(x - 100)", y="(y - 50)", W=320, H=180), V_DETECTIONS)
def p13(spark, d):
    v = boxes(spark, d).withColumns({"x": F.col("x") - 100, "y": F.col("y") - 50})
    return det.clamp(v, F.lit(320), F.lit(180)).select("frame", "ord", "x", "y", "w", "h")


@query("p14_masks", "SELECT frame, ord, greatest(0, x - 8) AS x, greatest(0, y - 4) AS y, least(600, x + w + 8) - greatest(0, x - 8) AS w, least(300, y + h + 6) - greatest(0, y - 4) AS h FROM v_det", V_DETECTIONS)
def p14(spark, d):
    return det.masks_and_cues(boxes(spark, d), 600, 300, ["RF"])[0]


@query("p14_watermark_cues", "SELECT frame, ord, text FROM v_det WHERE NOT contains(lower(text), 'rf')", V_DETECTIONS)
def p14b(spark, d):
    return det.masks_and_cues(boxes(spark, d), 600, 300, ["RF"])[1].select("frame", "ord", "text")


@query("p15_unstack_bands", CLAMPED.format(x="x", y="(CASE WHEN 2 * y + h < 300 THEN y + 20 ELSE y - 150 + 200 END)", W=600, H=320), V_DETECTIONS)
def p15(spark, d):
    return det.unstack_bands(boxes(spark, d), 150, 20, 200, 600, 320).select("frame", "ord", "x", "y", "w", "h")


@query("p16_abnormal_box", "SELECT frame, ord, CASE WHEN w * 10 > 50 * 9 OR h > 25 * 6 THEN 20 ELSE conf_pct END AS confidence_pct FROM v_det", V_DETECTIONS)
def p16(spark, d):
    return boxes(spark, d).select("frame", "ord", det.confidence_pct(F.col("w"), F.col("h"), F.col("conf_pct"), 50).alias("confidence_pct"))


UNION = "SELECT frame, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM v_det GROUP BY frame"


@query("a1_bbox_union", UNION, V_DETECTIONS)
def a1(spark, d):
    v = b.detections(spark, d).withColumn("box", F.struct("x", "y", "w", "h"))
    return v.groupBy("frame").agg(det.box_union(F.col("box")).alias("b")).select("frame", "b.*")


@query("a2_polygon_boxes", UNION, V_DETECTIONS)
def a2(spark, d):
    return det.frame_boxes(boxes(spark, d)).select("frame", "bbox.*")


@query("a3_best_detection", "SELECT frame, first(ord ORDER BY conf_pct DESC, ord) AS ord, max(conf_pct) AS conf_pct, first(text ORDER BY conf_pct DESC, ord) AS text FROM v_det WHERE trim(text) <> '' GROUP BY frame", V_DETECTIONS)
def a3(spark, d):
    return det.best_per_frame(boxes(spark, d)).select("frame", "ord", F.round(F.col("conf") * 100).cast("int").alias("conf_pct"), "text")


SCORES = "sc AS (SELECT frame, string_agg(text, ' ' ORDER BY ord) AS text, sum(conf_pct) AS s, count(*) AS n FROM v_det GROUP BY frame)"


def frame_scores(spark, d):
    g = boxes(spark, d).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("t"), (F.sum("conf_pct") / F.count("*") / 100).alias("conf"))
    return g.select("frame", F.array_join(F.col("t.text"), " ").alias("text"), "conf")


@query("a4_text_score", "SELECT frame, CAST(round(1000 * CASE WHEN text = '' THEN -1 WHEN trim(regexp_replace(text, '[^A-Za-z0-9_ ]', '', 'g')) = '' THEN 0 ELSE length(regexp_replace(text, '[^A-Za-z0-9_ ]', '', 'g')) + s / n / 100 * 12 END) AS BIGINT) AS score FROM sc", V_DETECTIONS, SCORES)
def a4(spark, d):
    return frame_scores(spark, d).select("frame", F.round(det.text_score(F.col("text"), F.col("conf")) * 1000).cast("bigint").alias("score"))


@query("a5_best_variant", "SELECT frame AS crop, first(ord ORDER BY conf_pct // 10 DESC, ord) AS variant, max(conf_pct // 10) AS score FROM v_det GROUP BY frame", V_DETECTIONS)
def a5(spark, d):
    return det.best_variant(b.detections(spark, d).select(F.col("frame").alias("crop"), F.col("ord").alias("variant"), F.floor(F.col("conf_pct") / 10).alias("score")))


METHODS = "me AS (SELECT frame, " + ", ".join(f"max(conf_pct) FILTER (ord = {i}) AS {m}" for i, m in enumerate("abcd", 1)) + " FROM v_det GROUP BY frame)"


@query("a6_cascade", """SELECT frame, CASE WHEN a > 40 THEN 'a' WHEN greatest(a - 20, b - 20) > 0 THEN CASE WHEN b > a THEN 'b' ELSE 'a' END WHEN d > c THEN 'd' ELSE 'c' END AS method
 FROM (SELECT frame, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c, coalesce(d, 0) AS d FROM me) q""", V_DETECTIONS, METHODS)
def a6(spark, d):
    v = b.detections(spark, d).groupBy("frame").pivot("ord", [1, 2, 3, 4]).agg(F.max("conf_pct")).na.fill(0)
    for i, m in enumerate("abcd", 1):
        v = v.withColumns({f"{m}_conf": F.col(str(i)) / 100, f"{m}_text": F.lit("xy"), f"{m}_score": F.col(str(i)) - 20})
    return det.cascade(v).select("frame", "method")


@query("a7_strip_assembly", """SELECT frame, ord, CASE WHEN hh * 4 > w * 5 AND w > 10 THEN greatest(2, CAST(round_even(hh / w, 0) AS INTEGER)) END AS n_slices,
 CASE WHEN hh * 4 > w * 5 AND w > 10 AND 2 * least(greatest(2, CAST(round_even(hh / w, 0) AS INTEGER)), 4) >= 5 THEN repeat('ab', least(greatest(2, CAST(round_even(hh / w, 0) AS INTEGER)), 4)) ELSE 'wxyz!' END AS text
 FROM (SELECT *, h * 5 AS hh FROM v_det) q""", V_DETECTIONS)
def a7(spark, d):
    v = b.detections(spark, d).select("frame", "ord", "w", (F.col("h") * 5).alias("h"), F.lit("wxyz!").alias("full_text"), F.array_repeat(F.lit("ab"), 4).alias("slices"))
    return det.strip_assembly(v).select("frame", "ord", "n_slices", "text")


READING = """ RECURSIVE r0 AS (SELECT *, 2 * y + h AS cy2, row_number() OVER (PARTITION BY frame ORDER BY 2 * y + h, ord) AS k FROM v_det),
 f AS (SELECT frame, k, ord, x, w, text, 1 AS line, cy2 AS first, CAST(h AS BIGINT) AS s, 1 AS n FROM r0 WHERE k = 1
  UNION ALL SELECT r0.frame, r0.k, r0.ord, r0.x, r0.w, r0.text,
   CASE WHEN abs(r0.cy2 - f.first) * 10 * f.n < 12 * f.s THEN f.line ELSE f.line + 1 END, CASE WHEN abs(r0.cy2 - f.first) * 10 * f.n < 12 * f.s THEN f.first ELSE r0.cy2 END,
   CASE WHEN abs(r0.cy2 - f.first) * 10 * f.n < 12 * f.s THEN f.s + r0.h ELSE r0.h END, CASE WHEN abs(r0.cy2 - f.first) * 10 * f.n < 12 * f.s THEN f.n + 1 ELSE 1 END
  FROM f JOIN r0 ON r0.frame = f.frame AND r0.k = f.k + 1),
 o AS (SELECT frame, ord, line, text, CAST(row_number() OVER (PARTITION BY frame ORDER BY line, 2 * x + w, ord) - 1 AS INTEGER) AS nth FROM f)"""


@query("w4_reading_order", "RECURSIVE WITH" + READING.replace(" RECURSIVE", "", 1) + " SELECT frame, ord, line, nth FROM o", V_DETECTIONS)
def w4(spark, d):
    return det.reading_order(b.detections(spark, d))


@query("a8_frame_text", "RECURSIVE WITH" + READING.replace(" RECURSIVE", "", 1) + " SELECT frame, string_agg(text, ' ' ORDER BY nth) AS text FROM o WHERE trim(text) <> '' GROUP BY frame", V_DETECTIONS)
def a8(spark, d):
    return det.frame_text(b.detections(spark, d))


def reuse_sql(keys: dict[str, str], change: float, flat: float | None, scale: float) -> str:
    """The fold over embeddings as samples, a row after another."""
    names = ", ".join(keys)
    total = "list_sum(list_transform({}, lambda x: {}))"
    dev = "sqrt(" + total.format("feat", "(CAST(x AS DOUBLE) - m) * (CAST(x AS DOUBLE) - m)") + " / len(feat))"
    flat_rule = "false" if flat is None else f"dev * {scale} < {flat}"
    near = total.format("list_zip(f.kept, s.feat)", "CAST(abs(x[1] - x[2]) AS DOUBLE)") + f" / len(s.feat) * {scale} < {change}"
    row = f"SELECT {names}, k, ord, CASE WHEN same THEN 'reuse' WHEN {flat_rule} THEN 'empty' ELSE 'read' END AS action, CASE WHEN same THEN held_at WHEN {flat_rule} THEN NULL ELSE ord END AS source_ord, CASE WHEN same OR {flat_rule} THEN kept ELSE feat END AS kept, CASE WHEN same OR {flat_rule} THEN held_at ELSE ord END AS held_at FROM "
    return f"""WITH RECURSIVE e AS (SELECT {", ".join(f"{v} AS {k}" for k, v in keys.items())}, vec_id AS ord, embedding AS feat, {total.format("embedding", "CAST(x AS DOUBLE)")} / len(embedding) AS m FROM embeddings),
 s AS (SELECT *, {dev} AS dev, row_number() OVER (PARTITION BY {names} ORDER BY ord) AS k FROM e),
 f AS ({row} (SELECT *, false AS same, CAST(NULL AS FLOAT[]) AS kept, CAST(NULL AS BIGINT) AS held_at FROM s WHERE k = 1) q
 UNION ALL {row} (SELECT s.*, coalesce(f.kept IS NOT NULL AND {near}, false) AS same, f.kept, f.held_at FROM f JOIN s ON {" AND ".join(f"s.{k} = f.{k}" for k in keys)} AND s.k = f.k + 1) q)
 SELECT {names}, ord, action, source_ord FROM f"""


def samples(spark, d):
    return b.table(spark, d, "embeddings").select(F.col("label").alias("media_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("feat"))


@query("r7_change_reuse", reuse_sql({"media_id": "label"}, 13.5, 11.0, 100.0))
def r7(spark, d):
    return det.change_reuse(samples(spark, d), change=13.5, flat=11.0, scale=100.0)


@query("r7_crop_reuse", reuse_sql({"media_id": "label", "x": "CAST(vec_id % 3 * 10 AS INTEGER)", "mode": "CASE WHEN vec_id % 2 = 0 THEN 'blur' ELSE 'black' END"}, 13.5, None, 100.0))
def r7b(spark, d):
    """Masked crops, each box and mode for itself; a changed crop is always worked on."""
    v = samples(spark, d).withColumns({"x": (F.col("ord") % 3 * 10).cast("int"), "mode": F.when(F.col("ord") % 2 == 0, "blur").otherwise("black")})
    return det.change_reuse(v, keys=("media_id", "x", "mode"), change=13.5, flat=None, scale=100.0)
