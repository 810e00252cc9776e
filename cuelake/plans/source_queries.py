"""Queries over documents, projects and other sources, with their SQL."""
from pyspark.sql import functions as F

from cuelake.operators.shared import new_path
from cuelake.plans import bindings as b
from cuelake.plans.bindings import V_CUES, V_MEDIA
from cuelake.plans.registry import query
from cuelake.sources import files
from cuelake.sources import subtitles as s

BACK = "SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY start_ms, ord) AS BIGINT) AS ord, start_ms, end_ms, text FROM v_cues"


@query("s1_srt_scan", BACK, V_CUES)
def s1(spark, d):
    return s.parse_srt(s.to_srt(b.cues(spark, d)).withColumnRenamed("document", "text"))


@query("s2_srt_training_scan", f"SELECT * FROM ({BACK}) q WHERE text <> ''", V_CUES)
def s2(spark, d):
    docs = s.to_srt(b.cues(spark, d)).select("media_id", s.decode_bytes(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("document", "UTF-8"))).alias("text"))
    return s.parse_srt(docs, keep_empty=False)


@query("s3_encoding_fallback", "SELECT doc_id, text FROM documents")
def s3(spark, d):
    latin = F.encode("text", "ISO-8859-1")
    utf = F.encode("text", "UTF-8")
    fits = F.col("text").rlike(r"^[\x00-\xFF]*$") & ~F.is_valid_utf8(latin.cast("string"))
    return b.table(spark, d, "documents").select("doc_id", s.decode_bytes(F.when((F.col("doc_id") % 2 == 0) & fits, latin).otherwise(utf)).alias("text"))


@query("u4_srt_table_function", BACK, V_CUES)
def u4(spark, d):
    s.srt_table(spark)
    s.to_srt(b.cues(spark, d)).createOrReplaceTempView("cuelake_srt")
    return spark.sql("SELECT d.media_id, c.ord, c.start_ms, c.end_ms, c.text FROM cuelake_srt d, LATERAL srt_cues(d.document) c")


def presets(spark, d):
    m = b.dealt(b.media(spark, d), "media_id")  # before the many constants of a preset
    color = lambda *c: F.array(*map(F.lit, c))
    return m.select("media_id", F.lit("fonts/Arial.ttf").alias("font_name"), (F.col("media_id") % 30 + 10).cast("int").alias("font_size"), color(255, 255, 0).alias("font_color"), color(0, 0, 16).alias("outline_color"), color(1, 2, 3).alias("bg_color"),
                    F.lit(2).alias("outline_width"), (F.col("media_id") % 2 * 50).cast("int").alias("bg_opacity"), F.lit(False).alias("use_bg_box"), (F.col("media_id") % 3 == 0).alias("smart_pos"), F.lit(8.0).alias("margin_v"), F.lit(5.0).alias("margin_h"), F.lit("percent").alias("margin_type"),
                    F.lit("left").alias("h_align"), F.lit("top").alias("v_align"), F.when(F.col("media_id") % 4 == 0, F.lit(50.0)).alias("custom_x"), F.lit(88.0).alias("custom_y"), (F.col("width") + 100).alias("width"), (F.col("height") + 100).alias("height"))


STYLES = """SELECT media_id, 'Style: Default,Arial,' || ((media_id % 30 + 10) * 3 // 2) || ',&H0000FFFF,&H000000FF,&H00100000,&H' || CASE media_id % 2 WHEN 0 THEN '33' ELSE '80' END || '030201,0,0,0,0,100,100,0,0,' ||
 CASE WHEN media_id % 3 = 0 THEN 3 ELSE 1 END || ',' || CASE WHEN media_id % 3 = 0 THEN 0 ELSE 2 END || ',0,' || CASE WHEN media_id % 4 = 0 THEN 5 ELSE 7 END || ',' || ((width + 100) * 5 // 100) || ',' || ((width + 100) * 5 // 100) || ',' || ((height + 100) * 8 // 100) || ',1' AS style FROM v_media"""


@query("s6_ass_styles", STYLES, V_MEDIA)
def s6(spark, d):
    return s.ass_styles(presets(spark, d))


#: The dialogue lines of a medium, and its file; times in hundredths of a second.
CENTIS = "(SELECT (c // 360000) || ':' || lpad(CAST(c // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(c // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') FROM (SELECT CAST(round_even(greatest({}, 0) / 10.0, 0) AS BIGINT) AS c) h)"
ASS = "st AS (" + STYLES + "), dl AS (SELECT v.media_id, string_agg('Dialogue: 0,' || " + CENTIS.format("v.start_ms") + " || ',' || " + CENTIS.format("v.end_ms") + r""" || ',Default,,0000,0000,0000,,' ||
  CASE WHEN v.media_id % 4 = 0 THEN printf('{\an5\pos(%.1f,%.1f)}', (m.width + 100) * 50.0 / 100, (m.height + 100) * 88.0 / 100) ELSE '' END || trim(v.text), chr(10) ORDER BY v.ord) AS lines
  FROM v_cues v JOIN v_media m ON m.media_id = v.media_id WHERE trim(v.text) <> '' GROUP BY v.media_id)
 SELECT m.media_id, concat_ws(chr(10), '[Script Info]', 'ScriptType: v4.00+', 'PlayResX: ' || (m.width + 100), 'PlayResY: ' || (m.height + 100), '', '[V4+ Styles]', 'Format: """ + s.ASS_STYLE_FIELDS + """', st.style, '', '[Events]',
  'Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text', coalesce(dl.lines, '')) AS document FROM v_media m JOIN st ON st.media_id = m.media_id LEFT JOIN dl ON dl.media_id = m.media_id"""


@query("s5_ass_sink", "WITH " + ASS, V_CUES, V_MEDIA)
def s5(spark, d):
    return s.to_ass(b.dealt(b.cues(spark, d), "media_id"), presets(spark, d))


@query("s4_srt_files", BACK, V_CUES)
def s4_files(spark, d):
    """A file a medium by the data source, read back by it."""
    at = new_path(spark, "srt-files")
    files.save(s.srt_parts(b.cues(spark, d)), at)
    medium = F.regexp_extract("path", r"([^/]*)\.srt$", 1).cast("bigint")
    return files.read(spark, at).select(medium.alias("media_id"), "ord", "start_ms", "end_ms", "text")


def projects(spark, d):
    """Orders as editing projects: line items as segments, every second with its text."""
    li = b.detections(spark, d).withColumn("id", F.concat(F.lit("m"), F.col("ord").cast("string")))
    seg = F.struct(F.col("id").alias("material_id"), F.struct((F.col("x").cast("bigint") * 1000).alias("start"), (F.col("w").cast("bigint") * 1000).alias("duration")).alias("target_timerange"))
    text = F.when(F.col("ord") % 3 == 0, F.concat(F.lit('{"text":"'), "text", F.lit('"}'))).otherwise(F.concat(F.lit("<b>"), "text", F.lit("</b>")))
    doc = F.to_json(F.struct(F.struct(F.collect_list(F.when(F.col("ord") % 2 == 1, F.struct("id", text.alias("content")))).alias("texts")).alias("materials"), F.array(F.struct(F.collect_list(seg).alias("segments"))).alias("tracks")))
    return li.groupBy(F.col("frame").alias("media_id")).agg(doc.alias("json"))


PROJECT = "SELECT frame AS media_id, CAST(row_number() OVER (PARTITION BY frame ORDER BY x, 'm' || ord) AS BIGINT) AS ord, x::BIGINT AS start_ms, (x + w)::BIGINT AS end_ms, trim(text) AS text FROM v_det WHERE ord % 2 = 1 AND trim(text) <> ''"


@query("s10_project_cues", PROJECT, b.V_DETECTIONS)
def s10(spark, d):
    return s.project_cues(projects(spark, d))


@query("j1_segments_materials", f"SELECT media_id, count(*) AS n FROM ({PROJECT}) q GROUP BY 1", b.V_DETECTIONS)
def j1(spark, d):
    return s.project_cues(projects(spark, d)).groupBy("media_id").agg(F.count("*").alias("n"))


@query("s11_project_listing", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'p' || o_custkey ELSE 'q' || o_custkey END AS name FROM orders")
def s11(spark, d):
    o = b.table(spark, d, "orders")
    even = F.col("o_orderkey") % 2 == 0
    c = F.col("o_custkey").cast("string")
    path = F.when(even, F.concat(F.lit("/x/p"), c, F.lit("/Timelines/draft.json"))).otherwise(F.concat(F.lit("/x/q"), c, F.lit("/draft.json")))
    return s.project_listing(o.select("o_orderkey", path.alias("path"), F.col("o_orderdate").alias("modified"))).select("o_orderkey", "name")


@query("s12_training_manifest", "SELECT media_id, n, (start_ms + end_ms) * fps // 2000 AS frame, 'images/sub_' || lpad(n::VARCHAR, 5, '0') || '.jpg' || chr(9) || text AS line FROM (SELECT c.*, m.fps, CAST(row_number() OVER (PARTITION BY c.media_id ORDER BY start_ms, ord) AS INTEGER) AS n FROM v_cues c JOIN v_media m USING (media_id)) q", V_CUES, V_MEDIA)
def s12(spark, d):
    return s.manifest(b.cues(spark, d), b.media(spark, d))


@query("s13_json_lists", "SELECT media_id, ord AS id, text FROM v_cues WHERE media_id % 3 = 0", V_CUES)
def s13(spark, d):
    lists = b.cues(spark, d).groupBy("media_id").agg(F.to_json(F.collect_list(F.struct(F.col("ord").alias("id"), "text"))).alias("json"))
    broken = F.when(F.col("media_id") % 3 == 1, F.concat(F.lit('{"items":'), "json", F.lit("}"))).when(F.col("media_id") % 3 == 2, F.lit(None).cast("string")).otherwise(F.col("json"))
    return s.json_list(lists.withColumn("json", broken), "id bigint, text string")


@query("s9_slang_json", "SELECT 'w' || vec_id AS zh, 'v' || label AS vi, CASE WHEN vec_id % 2 = 0 THEN 'c' ELSE 'Douyin/Bilibili' END AS category, CASE WHEN vec_id % 2 = 0 THEN 'Web' ELSE 'Douyin/Bilibili' END AS source FROM embeddings")
def s9(spark, d):
    e = b.table(spark, d, "embeddings")
    i, v = F.col("vec_id").cast("string"), F.col("label").cast("string")
    item = F.when(F.col("vec_id") % 2 == 0, F.concat(F.lit('"w'), i, F.lit('":{"vi":"v'), v, F.lit('","category":"c","source":"Web"}'))).otherwise(F.concat(F.lit('"w'), i, F.lit('":"v'), v, F.lit('"')))
    docs = e.groupBy("label").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(item), ","), F.lit("}")).alias("json"))
    return s.slang_rows(docs)


@query("s15_prompt_upsert", "SELECT conv_id AS id, CASE WHEN conv_id % 3 = 0 THEN 'new' ELSE 'old' END AS title FROM (SELECT DISTINCT conv_id FROM conversations) q WHERE conv_id % 5 <> 0")
def s15(spark, d):
    from cuelake.operators.lexicon import delete, upsert

    ids = b.turns(spark, d).select(F.col("conv_id").cast("string").alias("id")).distinct()
    merged = upsert(ids.withColumn("title", F.lit("old")), ids.filter("id % 3 = 0").withColumn("title", F.lit("new")), "id")
    return delete(merged, ids.filter("id % 5 = 0"), "id").select(F.col("id").cast("bigint").alias("id"), "title")


@query("s16_url_admission", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_matches(url, '^https?://[^/?#:]+') AS accepted FROM pages")
def s16(spark, d):
    return s.admit_urls(b.table(spark, d, "pages")).select("page_id", "host", "accepted")


@query("s17_ascii_path", "SELECT media_id, media_id % 2 = 0 AS ascii FROM v_media", V_MEDIA)
def s17(spark, d):
    return b.media(spark, d).select("media_id", s.is_ascii(F.when(F.col("media_id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("中文"), "path"))).alias("ascii"))
