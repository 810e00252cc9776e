"""Cues: admission, merging, grouping, planning and looking up by time.

A cue is a row (media_id, ord, start_ms, end_ms, text, ...); ord settles ties in the order
of the input. Every ordered operator partitions by media_id.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions.text import CJK, IDEOGRAPH, strip

#: Texts that stand for unread ones.
PLACEHOLDERS = ["[Chữ khó", "[Gemini]", "[Unreadable]", "[Lỗi"]

BEFORE = (W.unboundedPreceding, -1)
SO_FAR = (W.unboundedPreceding, 0)


def media_order(*columns):
    """The window of a medium in this order."""
    return W.partitionBy("media_id").orderBy(*columns)


def normalize_cues(raw: DataFrame) -> DataFrame:
    """Admission: types, defaults (times 0, confidence 1.0), stripped text, no blanks."""
    have = set(raw.columns)
    col = lambda c, kind, other: F.coalesce(F.col(c).try_cast(kind), F.lit(other).cast(kind)) if c in have else F.lit(other).cast(kind)
    bbox = F.col("bbox") if "bbox" in have else F.lit(None).cast("struct<x:int,y:int,w:int,h:int>")
    out = raw.select(
        F.col("media_id").cast("bigint").alias("media_id"), F.col("ord").cast("bigint").alias("ord"), col("start_ms", "bigint", 0).alias("start_ms"), col("end_ms", "bigint", 0).alias("end_ms"),
        strip(F.coalesce(F.col("text"), F.lit(""))).alias("text"), bbox.alias("bbox"), col("confidence", "double", 1.0).alias("confidence"),
    )
    return out.filter("text <> ''")


def drop_degenerate(cues: DataFrame, least_ms: int = 50) -> DataFrame:
    return cues.withColumn("text", strip(F.col("text"))).filter((F.col("text") != "") & (F.col("end_ms") - F.col("start_ms") > least_ms))


def drop_short_noise(cues: DataFrame) -> DataFrame:
    t = strip(F.coalesce("text", F.lit("")))
    return cues.filter((t != "") & ((F.length(t) >= 2) | t.rlike(CJK)))


def drop_brief(cues: DataFrame) -> DataFrame:
    """At least 180 ms with two ideographs or four characters, else 300 ms."""
    t = strip(F.col("text"))
    substantial = (F.regexp_count(t, F.lit(IDEOGRAPH)) >= 2) | (F.length(t) >= 4)
    return cues.filter(F.col("end_ms") - F.col("start_ms") >= F.when(substantial, 180).otherwise(300))


def is_placeholder(text: Column) -> Column:
    return F.coalesce(text.rlike("|".join(rf"\Q{p}\E" for p in PLACEHOLDERS)), F.lit(False))


def with_islands(cues: DataFrame, gap_ms: int, order: list[Column] | None = None) -> DataFrame:
    """Adds island: a new one starts where a cue begins more than gap_ms after everything
    before it has ended."""
    w = media_order(*(order or [F.col("start_ms"), F.desc(F.col("end_ms") - F.col("start_ms")), F.col("ord")]))
    opened = F.coalesce(F.col("start_ms") > F.max("end_ms").over(w.rowsBetween(*BEFORE)) + gap_ms, F.lit(True))
    return cues.withColumn("_new", opened.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(*SO_FAR))).drop("_new")


def merge_islands(cues: DataFrame, gap_ms: int = 80) -> DataFrame:
    """Merge the cues of each time island; the longest text stays, the first of equal ones."""
    order = F.struct(F.col("start_ms"), -(F.col("end_ms") - F.col("start_ms")), F.col("ord"))
    longest = F.min(F.struct((-F.length("text")).alias("n"), order.alias("o"), F.col("text")))
    merged = with_islands(cues, gap_ms).groupBy("media_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), longest.alias("t"), F.count("*").alias("n_cues"))
    return drop_degenerate(merged.select("media_id", "island", "start_ms", "end_ms", F.col("t.text").alias("text"), "n_cues"))


def group_by_gap(cues: DataFrame, gap_ms: int = 1000) -> DataFrame:
    """Adds grp: a cue joins the one before if it starts less than gap_ms after its end."""
    w = media_order("start_ms", "ord")
    new = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(w) >= gap_ms, F.lit(True)).cast("int")
    return cues.withColumn("_new", new).withColumn("grp", F.sum("_new").over(w.rowsBetween(*SO_FAR))).drop("_new")


def consecutive_equal(detections: DataFrame, interval_ms: int = 1500, lead_in_ms: int = 200) -> DataFrame:
    """Cues of consecutive detections (media_id, t_ms, ord, text) with one text; see
    folds.consecutive_either for those with translations and boxes."""
    w = media_order("t_ms", "ord")
    new = (~F.lag("text").over(w).eqNullSafe(F.col("text")) | F.lag("t_ms").over(w).isNull()).cast("int")
    return (
        detections.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(*SO_FAR)))
        .groupBy("media_id", "run").agg(F.greatest(F.min("t_ms") - lead_in_ms, F.lit(0)).alias("start_ms"), (F.max("t_ms") + interval_ms).alias("end_ms"), F.min("text").alias("text"), F.count("*").alias("n"))
    )


def chunk_plan(media: DataFrame, step_ms: int = 20_000, overlap_ms: int = 1_500, tail_ms: int = 1_000) -> DataFrame:
    """Chunks of each medium: starts 0, step, ...; length at most step + overlap. A rest
    shorter than tail_ms is taken up by the chunk before it."""
    d = F.col("duration_ms")
    last = F.floor((d - 1) / step_ms)
    short = (last > 0) & (d - last * step_ms < tail_ms)
    n = F.greatest(F.when(short, last).otherwise(last + 1), F.lit(1)).cast("int")
    start = F.col("chunk_idx").cast("bigint") * step_ms
    ends = F.when(F.col("chunk_idx") == n - 1, F.when(short, d).otherwise(F.least(start + step_ms + overlap_ms, d))).otherwise(F.least(start + step_ms + overlap_ms, d))
    return media.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), n - 1))).select("media_id", "chunk_idx", start.alias("start_ms"), (ends - start).alias("dur_ms"))


def resume_plan(media: DataFrame, checkpoints: DataFrame, step_ms: int = 20_000, overlap_ms: int = 1_500, tail_ms: int = 1_000) -> DataFrame:
    """Chunks still to do from the last second of a checkpoint (media_id, path, done_ms, n_cues)
    of the same path; a rest shorter than tail_ms is left out once there are cues."""
    c = checkpoints.select("media_id", F.col("path").alias("c_path"), "done_ms", "n_cues")
    at = F.when(F.col("c_path") == F.col("path"), F.col("done_ms")).otherwise(F.lit(0))
    cues = F.when(F.col("c_path") == F.col("path"), F.col("n_cues")).otherwise(F.lit(0))
    m = media.join(c, "media_id", "left").withColumns({"from_ms": F.coalesce(at, F.lit(0)).cast("bigint"), "had": F.coalesce(cues, F.lit(0))}).filter("from_ms < duration_ms")
    n = F.ceil((F.col("duration_ms") - F.col("from_ms")) / step_ms).cast("int")
    rows = m.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("start_ms", F.col("from_ms") + F.col("k").cast("bigint") * step_ms)
    rest = F.col("duration_ms") - F.col("start_ms")
    return rows.filter(~((rest < tail_ms) & ((F.col("had") > 0) | (F.col("k") > 0)))).select(
        "media_id", F.floor(F.col("start_ms") / step_ms).cast("bigint").alias("chunk_idx"), "start_ms", F.least(F.lit(step_ms + overlap_ms), rest).alias("dur_ms")
    )


def shift_by_chunk(cues: DataFrame, chunks: DataFrame) -> DataFrame:
    """Cues with times inside their chunk (chunk_idx) on the clock of the medium."""
    offset = chunks.select("media_id", "chunk_idx", F.col("start_ms").alias("_offset"))
    return cues.join(offset.hint("merge"), ["media_id", "chunk_idx"]).withColumns({"start_ms": F.col("start_ms") + F.col("_offset"), "end_ms": F.col("end_ms") + F.col("_offset")}).drop("_offset")


def reassemble(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Every planned chunk with its number of cues; chunks without a result have none."""
    n = results.groupBy("media_id", "chunk_idx").agg(F.count("*").alias("n_cues"))
    return plan.join(n.hint("merge"), ["media_id", "chunk_idx"], "left").select("media_id", "chunk_idx", "start_ms", F.coalesce("n_cues", F.lit(0)).alias("n_cues"))


def lay_out(rows: DataFrame, default_ms: int = 2_500, silence_ms: int = 350) -> DataFrame:
    """Rows (media_id, ord, text, dur_ms) end to end with silence between; blank ones go."""
    w = media_order("ord").rowsBetween(*BEFORE)
    length = F.when(F.col("dur_ms") > 0, F.col("dur_ms")).otherwise(F.lit(default_ms))
    kept = rows.filter(strip(F.coalesce("text", F.lit(""))) != "").withColumn("_d", length)
    return kept.withColumn("start_ms", F.coalesce(F.sum(F.col("_d") + silence_ms).over(w), F.lit(0)).cast("bigint")).withColumn("end_ms", F.col("start_ms") + F.col("_d")).drop("_d")


def fill_leading_gap(cues: DataFrame, least_ms: int = 1_000, text: str = "") -> DataFrame:
    """A cue from 0 to the first start, where that lies after least_ms."""
    first = cues.groupBy("media_id").agg(F.min("start_ms").alias("end_ms")).filter(F.col("end_ms") > least_ms)
    return cues.select("media_id", "start_ms", "end_ms", "text").unionByName(first.select("media_id", F.lit(0).cast("bigint").alias("start_ms"), "end_ms", F.lit(text).alias("text")))


def apply_edits(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (media_id, ord, action, start_ms, end_ms): `split` at the middle, `move` to new
    times unless start >= end, `merge` with the next cue of the medium (texts joined)."""
    e = edits.select("media_id", "ord", "action", F.col("start_ms").alias("e_start"), F.col("end_ms").alias("e_end"))
    w = media_order("start_ms", "ord")
    j = cues.join(e, ["media_id", "ord"], "left").withColumns({
        "n_end": F.lead("end_ms").over(w), "n_text": F.lead("text").over(w), "before": F.lag("action").over(w)})
    j = j.filter(~F.col("before").eqNullSafe("merge"))
    mid = F.floor((F.col("start_ms") + F.col("end_ms")) / 2).cast("bigint")
    piece = lambda s, t, x, k: F.struct(s.alias("start_ms"), t.alias("end_ms"), x.alias("text"), F.lit(k).alias("part"))
    s, t, x = F.col("start_ms"), F.col("end_ms"), F.col("text")
    moved = (F.col("action") == "move") & (F.col("e_start") < F.col("e_end"))
    rows = F.when(F.col("action") == "split", F.array(piece(s, mid, x, 0), piece(mid, t, x, 1))).when(
        (F.col("action") == "merge") & F.col("n_end").isNotNull(), F.array(piece(s, F.greatest(t, F.col("n_end")), F.concat_ws(" ", x, F.col("n_text")), 0))
    ).otherwise(F.array(piece(F.when(moved, F.col("e_start")).otherwise(s), F.when(moved, F.col("e_end")).otherwise(t), x, 0)))
    return j.select("media_id", "ord", F.explode(rows).alias("c")).select("media_id", "ord", "c.*")


def active_cue(frames: DataFrame, cues: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """For each frame (media_id, frame_no, t_ms) the first cue by start with
    start <= t <= end and a text that is no placeholder; frames without one are kept.

    Cues are laid into time buckets, so the interval join is an equi-join.
    """
    live = cues.filter(~is_placeholder(F.col("text")) & (F.col("end_ms") >= F.col("start_ms")))
    laid = live.select("media_id", "ord", "start_ms", "end_ms", "text", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.col("end_ms") / bucket_ms))).alias("b"))
    at = frames.withColumn("b", F.floor(F.col("t_ms") / bucket_ms))
    first = (
        at.join(laid.hint("merge"), ["media_id", "b"]).filter("start_ms <= t_ms AND t_ms <= end_ms")
        .groupBy("media_id", "frame_no").agg(F.min(F.struct("start_ms", "ord", "end_ms", "text")).alias("c"))
    )
    return frames.join(first.hint("merge"), ["media_id", "frame_no"], "left").select("media_id", "frame_no", "t_ms", F.col("c.ord").alias("ord"), F.col("c.text").alias("text"))


def probe_schedule(cues: DataFrame, gap_ms: int = 1000, long_ms: int = 500) -> DataFrame:
    """Probe times of each gap group: the middle, then 20 % and 80 % of a long one."""
    g = group_by_gap(cues, gap_ms).groupBy("media_id", "grp").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    d = F.col("end_ms") - F.col("start_ms")
    at = lambda n: F.floor(F.col("start_ms") + d * n / 10).cast("bigint")
    times = F.when(d > long_ms, F.array(at(5), at(2), at(8))).otherwise(F.array(at(5)))
    return g.select("media_id", "grp", F.posexplode(times).alias("probe", "t_ms"))


def best_probe(probes: DataFrame, enough_pct: int = 30) -> DataFrame:
    """The probe used for each group (media_id, grp, probe, conf_pct): later ones are only
    looked at while the best so far is under enough_pct, and must be strictly better."""
    w = W.partitionBy("media_id", "grp").orderBy("probe")
    seen = probes.withColumn("_best", F.max("conf_pct").over(w.rowsBetween(*BEFORE))).filter(F.col("_best").isNull() | (F.col("_best") < enough_pct))
    return seen.groupBy("media_id", "grp").agg(F.max(F.struct("conf_pct", (-F.col("probe")).alias("p"))).alias("b")).select("media_id", "grp", (-F.col("b.p")).alias("probe"), F.col("b.conf_pct").alias("conf_pct"))


def speech_fit(cues: DataFrame, clips: DataFrame) -> DataFrame:
    """Cues with a clip (media_id, ord, clip_ms): tempo factor, chain of filters, cut length."""
    slot = F.col("end_ms") - F.col("start_ms")
    j = cues.join(clips, ["media_id", "ord"]).filter((slot > 0) & (F.col("clip_ms") > 0) & (strip(F.coalesce("text", F.lit(""))) != ""))
    raw = F.col("clip_ms") / slot
    factor = F.greatest(F.when(raw > 1.05, raw).otherwise(F.lit(1.0)), F.lit(0.5))
    twos = F.greatest(F.ceil(F.log2(factor)) - 1, F.lit(0)).cast("int")
    # log2 may be off by one at powers of two: the rest is kept within (1, 2]
    twos = F.when(factor / F.pow(F.lit(2.0), twos) > 2.0, twos + 1).when((twos > 0) & (factor / F.pow(F.lit(2.0), twos) <= 1.0), twos - 1).otherwise(twos)
    rest = F.col("factor") / F.pow(F.lit(2.0), F.col("twos"))
    return j.withColumns({"factor": factor, "twos": twos}).select(
        "media_id", "ord", "factor", (F.abs(F.col("factor") - 1) < 0.05).alias("copy"),
        F.when(F.abs(F.col("factor") - 1) < 0.05, F.array().cast("array<double>")).otherwise(F.concat(F.array_repeat(F.lit(2.0), F.col("twos")), F.array(F.round(rest, 4)))).alias("chain"),
        F.least(F.floor(F.col("clip_ms") / F.col("factor")), slot).cast("bigint").alias("play_ms"),
    )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """start_ms of parts that follow one another from part 0, each text's after another's."""
    ended = 0  # of the text that the last batch stopped in
    for b in batches:
        if not b.num_rows:
            continue
        took, first = b["dur_ms"].to_numpy(zero_copy_only=False), b["part"].to_numpy(zero_copy_only=False) == 0
        before = np.cumsum(took) - took
        begins = np.flatnonzero(first)
        base = np.concatenate(([-ended], before[begins]))[np.cumsum(first)]
        start = before - base
        ended = int(start[-1] + took[-1])
        yield b.set_column(b.schema.get_field_index("start_ms"), "start_ms", pa.array(start, pa.int64()))


def masked_timeline(rows: DataFrame, clips: DataFrame | None = None, tone_ms: int = 400, missing_ms: int = 300) -> DataFrame:
    """Parts of texts with runs of *: a tone each, silence for marks, clips (text, clip_ms)
    for words; with running start times. Texts without * have one part.

    Without clips the parts of a text stay where it is read, and its times are added up as they pass; clips
    are joined, so that there a window puts the parts in line again.
    """
    part = F.regexp_extract_all("text", F.lit(r"\*+|[^*]+"), 0)
    parts = rows.select("media_id", "ord", F.posexplode(part).alias("part", "piece"))
    kind = F.when(F.col("piece").startswith("*"), "tone").when(F.col("piece").rlike(r"^(?U:[\s,.!?，。！？]*)$"), "silence").otherwise("speech")
    parts = parts.withColumn("kind", kind)
    if clips is not None:
        parts = parts.join(clips.withColumnRenamed("text", "piece").dropDuplicates(["piece"]).hint("merge"), "piece", "left")
    else:
        parts = parts.withColumn("clip_ms", F.lit(None).cast("bigint"))
    length = F.when(F.col("kind") == "tone", tone_ms).when(F.col("kind") == "silence", F.length("piece") * 50).otherwise(F.coalesce("clip_ms", F.lit(missing_ms)))
    parts = parts.withColumn("dur_ms", length.cast("bigint"))
    if clips is None:
        made = parts.select("media_id", "ord", "part", "kind", F.lit(0).cast("bigint").alias("start_ms"), "dur_ms")
        return made.mapInArrow(_running, made.schema)
    w = W.partitionBy("media_id", "ord").orderBy("part").rowsBetween(*BEFORE)
    return parts.withColumn("start_ms", F.coalesce(F.sum("dur_ms").over(w), F.lit(0)).cast("bigint")).select("media_id", "ord", "part", "kind", "start_ms", "dur_ms")


def search(cues: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Per medium, the number of rows whose columns hold term in any case."""
    hit = lambda c: F.count_if(F.contains(F.lower(c), F.lit(term.lower()))).alias(f"hits_{c}")
    any_hit = F.array_contains(F.array(*[F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False)) for c in columns]), True)
    return cues.groupBy("media_id").agg(*[hit(c) for c in columns], F.count_if(any_hit).alias("hits_all"))
