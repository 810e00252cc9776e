"""Subtitle files, scripts and editing projects as tables, and back."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions.text import strip, strip_markup
from cuelake.functions.time import TIMECODE, ass_time, parse_timecode, srt_time
from cuelake.operators.cues import is_placeholder


def decode_bytes(content: Column) -> Column:
    """UTF-8 (BOM dropped), UTF-16 by its BOM, else Latin-1."""
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16"))
        .when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^﻿", ""))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


#: Encodings tried one after another for rule files.
ENCODINGS = ["utf-8-sig", "utf-16", "utf-8", "utf-16-le", "utf-16-be", "cp1258", "latin-1"]


def decode_one(content: bytes | None) -> str | None:
    """Bytes in the first of ENCODINGS that takes them; the last one takes any."""
    if content is None:
        return None
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeError:
            continue


def decode_any(content: Column) -> Column:
    """decode_one as a column: bytes that are UTF-8 stay in the JVM, only others go to Python."""

    @F.pandas_udf("string")
    def rest(x: pd.Series) -> pd.Series:
        return x.map(decode_one)

    utf8 = F.is_valid_utf8(content.cast("string"))
    return F.when(utf8, F.regexp_replace(content.cast("string"), "^\ufeff", "")).otherwise(rest(F.when(~utf8, content)))


def read_documents(spark: SparkSession, path: str, glob: str = "*.srt") -> DataFrame:
    """(path, modified, text): whole files of any of the accepted encodings."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), decode_bytes(F.col("content")).alias("text"))


def parse_srt(documents: DataFrame, key: str = "media_id", *, keep_empty: bool = True) -> DataFrame:
    """Cues (key, ord, start_ms, end_ms, text) of documents (key, text).

    A time line holds --> and two time codes. Its text is the stripped lines up to a blank
    line, another --> line, or a number line right before one, joined by spaces.
    """
    lines = documents.select(key, F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line", "raw")).withColumn("raw", strip(F.col("raw")))
    w = W.partitionBy(key).orderBy("line")
    codes = F.regexp_extract_all("raw", F.lit(TIMECODE), 0)
    marked = lines.withColumns({
        "arrow": F.col("raw").contains("-->"), "codes": codes,
    }).withColumns({"time": F.col("arrow") & (F.size("codes") >= 2), "next_arrow": F.coalesce(F.lead("arrow").over(w), F.lit(False))})
    marked = marked.withColumn("cue", F.sum(F.col("time").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))).filter("cue > 0")
    ends = (F.col("raw") == "") | (F.col("arrow") & ~F.col("time")) | (F.col("raw").rlike(r"^\p{Nd}+$") & F.col("next_arrow"))
    in_cue = W.partitionBy(key, "cue").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    body = marked.withColumn("closed", F.max((ends & ~F.col("time")).cast("int")).over(in_cue))
    text = F.array_sort(F.collect_list(F.when((F.col("closed") == 0) & ~F.col("time"), F.struct("line", "raw"))))
    out = body.groupBy(key, "cue").agg(F.max(F.when(F.col("time"), F.struct(F.get("codes", F.lit(0)).alias("a"), F.get("codes", F.lit(1)).alias("b")))).alias("t"), text.alias("x"))
    cues = out.select(key, F.col("cue").cast("bigint").alias("ord"), parse_timecode(F.col("t.a")).alias("start_ms"), parse_timecode(F.col("t.b")).alias("end_ms"), F.array_join(F.col("x.raw"), " ").alias("text"))
    return cues if keep_empty else cues.filter("text <> ''")


def srt_parts(cues: DataFrame) -> DataFrame:
    """(media_id, n, part): the file of a medium in parts, its cues renumbered from 1 by start."""
    n = F.row_number().over(W.partitionBy("media_id").orderBy("start_ms", "ord"))
    block = F.concat(F.when(F.col("n") > 1, "\n").otherwise(""), F.col("n").cast("string"), F.lit("\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return cues.withColumn("n", n).select("media_id", "n", block.alias("part"))


def joined(parts: DataFrame) -> DataFrame:
    """(media_id, document): the parts of a medium put together; files.save writes them without that."""
    held = parts.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("p"))
    return held.select("media_id", F.array_join(F.col("p.part"), "").alias("document"))


def to_srt(cues: DataFrame) -> DataFrame:
    """(media_id, document): cues renumbered from 1 by start."""
    return joined(srt_parts(cues))


def ass_styles(presets: DataFrame) -> DataFrame:
    """(media_id, style): the style line of each preset, see ass_style."""
    return presets.select("media_id", ass_style().alias("style"))


def ass_style() -> Column:
    """The style line of a preset (media_id, font_name, font_size,
    font_color, outline_color, bg_color array<int>, outline_width, bg_opacity, use_bg_box,
    smart_pos, margin_v, margin_h, margin_type, h_align, v_align, custom_x, custom_y, width, height)."""
    two = lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")
    color = lambda c, alpha: F.concat(F.lit("&H"), two(alpha), two(F.get(F.col(c), F.lit(2))), two(F.get(F.col(c), F.lit(1))), two(F.get(F.col(c), F.lit(0))))
    opaque = F.lit(0)
    back = 255 - F.floor(F.when(F.col("bg_opacity") > 0, F.col("bg_opacity")).otherwise(F.lit(80)) * 255 / 100)
    margin = lambda v, side: F.when(F.col("margin_type") == "percent", F.floor(F.col(side) * F.col(v) / 100)).otherwise(F.floor(v)).cast("int")
    align = F.when(F.col("custom_x").isNotNull(), 5).otherwise(
        F.coalesce(F.when(F.col("h_align") == "left", 1).when(F.col("h_align") == "right", 3), F.lit(2)) + F.coalesce(F.when(F.col("v_align") == "middle", 3).when(F.col("v_align") == "top", 6), F.lit(0))
    )
    border = F.when(F.col("smart_pos") | F.col("use_bg_box"), 3).otherwise(1)
    outline = F.when(F.col("smart_pos"), 0).otherwise(F.col("outline_width"))
    font = F.regexp_replace("font_name", r"^.*[/\\]|\.(ttf|otf|ttc)$", "")
    fields = ["Default", font, F.floor(F.col("font_size") * 1.5), color("font_color", opaque), "&H000000FF", color("outline_color", opaque), color("bg_color", back), *"0000", 100, 100, 0, 0, border, outline, 0, align, margin("margin_h", "width"), margin("margin_h", "width"), margin("margin_v", "height"), 1]
    return F.concat(F.lit("Style: "), F.concat_ws(",", *[f.cast("string") if isinstance(f, Column) else F.lit(str(f)) for f in fields]))


ASS_STYLE_FIELDS = "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"


def ass_parts(cues: DataFrame, presets: DataFrame) -> DataFrame:
    """(media_id, n, part): script header with one style, then a dialogue line a readable cue, in the order of ord.

    Cues may have bbox; a custom position of the preset comes first, then the centre of
    the box where smart_pos is set. Every medium with a preset has a file.
    """
    heads = presets.filter("media_id IS NOT NULL").select("media_id", F.lit(0).alias("n"), ass_head().alias("part"))
    return heads.unionByName(ass_dialogues(cues, presets))


def ass_head() -> Column:
    """The header of a preset's script."""
    return F.concat_ws("\n", F.lit("[Script Info]\nScriptType: v4.00+"), F.concat(F.lit("PlayResX: "), "width"), F.concat(F.lit("PlayResY: "), "height"), F.lit(f"\n[V4+ Styles]\nFormat: {ASS_STYLE_FIELDS}"), ass_style(),
                       F.lit("\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"))


def ass_dialogues(cues: DataFrame, presets: DataFrame) -> DataFrame:
    """(media_id, n, part): the dialogue lines of ass_parts. Of the presets only the position meets the cues."""
    has_box = "bbox" in cues.columns
    pos = lambda x, y: F.format_string("{\\an5\\pos(%.1f,%.1f)}", x.cast("double"), y.cast("double"))
    placed = F.when(F.col("custom_x").isNotNull(), pos(F.col("width") * F.col("custom_x") / 100, F.col("height") * F.col("custom_y") / 100))
    places = presets.select("media_id", placed.alias("tag"), *[F.col(c) for c in ("custom_x", "smart_pos") if has_box])
    j = cues.filter((strip(F.coalesce("text", F.lit(""))) != "") & ~is_placeholder(F.col("text"))).join(places.hint("merge"), "media_id")
    tag = F.col("tag")
    if has_box:
        boxed = F.col("custom_x").isNull() & F.col("smart_pos") & F.col("bbox").isNotNull()
        tag = F.when(boxed, pos(F.col("bbox.x") + F.col("bbox.w") / 2, F.col("bbox.y") + F.col("bbox.h") / 2)).otherwise(tag)
    line = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("end_ms")), F.lit(",Default,,0000,0000,0000,,"), F.coalesce(tag, F.lit("")), F.replace(strip(F.col("text")), F.lit("\n"), F.lit("\\N")))
    n = F.row_number().over(W.partitionBy("media_id").orderBy("ord", "start_ms", "end_ms", "text"))
    return j.select("media_id", n.alias("n"), line.alias("line")).select("media_id", "n", F.concat(F.when(F.col("n") > 1, "\n").otherwise(""), "line").alias("part"))


def to_ass(cues: DataFrame, presets: DataFrame) -> DataFrame:
    """(media_id, document): the parts of ass_parts put together. Headers are made once presets have met their lines, so that
    none is sent or sorted."""
    lines = joined(ass_dialogues(cues, presets)).withColumnRenamed("document", "lines")
    found = presets.filter("media_id IS NOT NULL").join(lines.hint("merge"), "media_id", "left")
    return found.select("media_id", F.concat(ass_head(), F.coalesce("lines", F.lit(""))).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """One folder a medium, one text file in it, byte for byte."""
    documents.select("media_id", F.col("document").alias("value")).write.partitionBy("media_id").option("lineSep", "\n").text(path)


PROJECT = "materials struct<texts:array<struct<id:string,content:string>>>, tracks array<struct<segments:array<struct<material_id:string,target_timerange:struct<start:bigint,duration:bigint>,source_timerange:struct<start:bigint,duration:bigint>>>>>"


def project_cues(projects: DataFrame, key: str = "media_id") -> DataFrame:
    """Cues of editing projects (key, json): segments joined to their text materials.

    Text is content's JSON `.text`, else the value of a "text" field in it, else the content
    without markup; blank texts go. Microseconds become milliseconds.
    """
    p = projects.select(key, F.from_json("json", PROJECT).alias("p"))
    texts = p.select(key, F.inline("p.materials.texts")).select(key, F.col("id").alias("material_id"), "content")
    parsed = F.get_json_object("content", "$.text")
    field = F.nullif(F.regexp_extract("content", r'"text"\s*:\s*"([^"]*)"', 1), F.lit(""))
    texts = texts.withColumn("text", strip(F.coalesce(parsed, field, strip_markup(F.col("content")))))
    segments = p.select(key, F.explode("p.tracks").alias("t")).select(key, F.inline("t.segments"))
    when = F.coalesce("target_timerange", "source_timerange")
    segments = segments.select(key, "material_id", F.floor(when["start"] / 1000).cast("bigint").alias("start_ms"), F.floor((when["start"] + when["duration"]) / 1000).cast("bigint").alias("end_ms"))
    out = segments.join(texts.hint("merge"), [key, "material_id"]).filter("text <> ''")
    return out.withColumn("ord", F.row_number().over(W.partitionBy(key).orderBy("start_ms", "material_id")).cast("bigint")).select(key, "ord", "start_ms", "end_ms", "text")


def project_listing(files: DataFrame) -> DataFrame:
    """Projects (path, modified) newest first, named by folder; a `Timelines` folder by the one above."""
    parts = F.split("path", "/")
    folder, above = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-3))
    return files.withColumn("name", F.when(folder == "Timelines", above).otherwise(folder)).orderBy(F.desc("modified"), "path")


def manifest(cues: DataFrame, media: DataFrame) -> DataFrame:
    """Recognition-training lines: the middle frame of every cue and its text."""
    j = cues.join(media.select("media_id", "fps"), "media_id")
    n = F.row_number().over(W.partitionBy("media_id").orderBy("start_ms", "ord"))
    frame = F.floor((F.col("start_ms") + F.col("end_ms")) * F.col("fps") / 2000).cast("bigint")
    return j.filter(strip(F.col("text")) != "").withColumn("n", n).select("media_id", "n", frame.alias("frame"), F.concat(F.lit("images/sub_"), F.lpad(F.col("n").cast("string"), 5, "0"), F.lit(".jpg\t"), "text").alias("line"))


def json_list(documents: DataFrame, schema: str, column: str = "json") -> DataFrame:
    """Rows of a JSON list; a missing, broken or other document gives none."""
    is_list = F.col(column).rlike(r"^\s*\[")
    rest = [c for c in documents.columns if c != column]
    return documents.select(*rest, F.explode(F.coalesce(F.when(is_list, F.from_json(column, f"array<struct<{schema}>>")), F.array())).alias("_x")).select(*rest, "_x.*")


def slang_rows(documents: DataFrame, column: str = "json", default_source: str = "Douyin/Bilibili") -> DataFrame:
    """(zh, vi, category, source) of JSON objects whose values are objects or strings."""
    pairs = documents.select(F.explode(F.from_json(column, "map<string,string>")).alias("zh", "v"))
    s = F.when(F.col("v").rlike(r"^\s*\{"), F.from_json("v", "vi string, category string, source string"))
    return pairs.select(F.trim("zh").alias("zh"), F.coalesce(s["vi"], F.when(s.isNull(), F.col("v"))).alias("vi"), F.coalesce(s["category"], F.lit("Douyin/Bilibili")).alias("category"), F.coalesce(s["source"], F.lit(default_source)).alias("source")).filter("zh <> ''")


def admit_urls(rows: DataFrame, column: str = "url") -> DataFrame:
    """Adds host and accepted: http or https with a host, after trimming."""
    url = strip(F.coalesce(F.col(column), F.lit("")))
    host = F.try_parse_url(url, F.lit("HOST"))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return rows.withColumns({"host": host, "accepted": F.coalesce(scheme.isin("http", "https") & (host != ""), F.lit(False))})


def is_ascii(path: Column) -> Column:
    return path.rlike(r"^\p{ASCII}*$")


def srt_table(spark: SparkSession) -> None:
    """Register the table function srt_cues(text)."""
    import re

    from pyspark.sql.functions import udtf

    code = re.compile(TIMECODE)

    @udtf(returnType="ord bigint, start_ms bigint, end_ms bigint, text string")
    class SrtCues:
        def eval(self, text: str):
            lines = [x.strip() for x in (text or "").splitlines()]
            ms = lambda t: sum(int(x) * f for x, f in zip(t[:-1], (3_600_000, 60_000, 1000))) + int(t[-1].ljust(3, "0"))
            n, i = 0, 0
            while i < len(lines):
                found = code.findall(lines[i]) if "-->" in lines[i] else []
                i += 1
                if len(found) < 2:
                    continue
                body = []
                while i < len(lines) and lines[i] and "-->" not in lines[i] and not (lines[i].isdigit() and i + 1 < len(lines) and "-->" in lines[i + 1]):
                    body.append(lines[i])
                    i += 1
                n += 1
                yield n, ms(re.split("[:,.]", found[0])), ms(re.split("[:,.]", found[1])), " ".join(body)

    spark.udtf.register("srt_cues", SrtCues)
