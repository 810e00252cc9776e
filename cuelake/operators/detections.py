"""Text boxes detected in frames: gates, geometry, reading order, scores and choices.

A detection is a row (frame, ord, pts array<struct<x,y>>, text, conf).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions.text import IDEOGRAPH, strip
from cuelake.operators.resume import folded

#: The text that stands for an unread box, and marks that count as noise alone.
UNREAD = "[Chữ khó - Nhấp quét Gemini]"
LONE_MARKS = ",.!?'-_~`\"^:;“”‘’'`，。！？-、"
BOX = "struct<x:int,y:int,w:int,h:int>"


def rectangle(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The four corners of a box, clockwise from the top left."""
    p = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h))


def filter_noise(det: DataFrame, *, least: float = 0.15, lone_least: float = 0.45) -> DataFrame:
    """Without blank texts, confidences under `least` and doubtful lone marks."""
    t = strip(F.coalesce("text", F.lit("")))
    lone = (F.length(t) == 1) & F.contains(F.lit(LONE_MARKS), t) & (F.col("conf") < lone_least)
    return det.filter((t != "") & (F.col("conf") >= least) & ~lone)


def force_scan(frames: DataFrame, det: DataFrame, *, least: float = 0.15) -> DataFrame:
    """Every detection, doubtful texts as UNREAD, and one UNREAD row for empty frames."""
    doubtful = F.col("conf") < least
    kept = det.select("frame", "ord", F.when(doubtful, UNREAD).otherwise(F.col("text")).alias("text"), "conf")
    return frames.select("frame").distinct().join(kept.hint("merge"), "frame", "left").select(
        "frame", F.coalesce("ord", F.lit(0)).alias("ord"), F.coalesce("text", F.when(F.col("ord").isNull(), F.lit(UNREAD))).alias("text"), F.when(F.col("ord").isNull(), F.lit(0.10)).otherwise(F.col("conf")).alias("conf")
    )


def gate(det: DataFrame, least: float, *, strict: bool = False) -> DataFrame:
    """Detections at (or, strictly, over) a reader's confidence."""
    return det.filter(F.col("conf") > least if strict else F.col("conf") >= least)


def rescale(det: DataFrame, sx: float, sy: float) -> DataFrame:
    return det.withColumn("pts", F.transform("pts", lambda p: F.struct((p["x"] / sx).alias("x"), (p["y"] / sy).alias("y"))))


def bounds(pts: Column) -> Column:
    """The axis-parallel box of a polygon, in whole pixels."""
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    i = lambda c: c.cast("int")
    return F.struct(i(F.array_min(xs)).alias("x"), i(F.array_min(ys)).alias("y"), i(F.array_max(xs) - F.array_min(xs)).alias("w"), i(F.array_max(ys) - F.array_min(ys)).alias("h"))


def box_union(box: Column) -> Column:
    """Aggregate: the smallest box around all non-null ones."""
    x, y = F.min(box["x"]), F.min(box["y"])
    return F.when(x.isNotNull(), F.struct(x.alias("x"), y.alias("y"), (F.max(box["x"] + box["w"]) - x).alias("w"), (F.max(box["y"] + box["h"]) - y).alias("h")))


def frame_boxes(det: DataFrame) -> DataFrame:
    return det.groupBy("frame").agg(box_union(bounds(F.col("pts"))).alias("bbox"))


def vision_items(responses: DataFrame, column: str = "json", least: int = 10) -> DataFrame:
    """Rows of answers [{original_text, translated_text, box_2d [ymin,xmin,ymax,xmax] 0..1000}]
    with width and height: pixel boxes at least `least` wide and high; blank texts go."""
    items = responses.select("frame", "width", "height", F.posexplode(F.from_json(column, "array<struct<original_text:string,translated_text:string,box_2d:array<int>>>")).alias("ord", "i"))
    px = lambda k, dim: F.floor(F.get(F.col("i.box_2d"), F.lit(k)) * F.col(dim) / 1000).cast("int")
    x, y = px(1, "width"), px(0, "height")
    box = F.struct(x.alias("x"), y.alias("y"), F.greatest(F.lit(least), px(3, "width") - x).alias("w"), F.greatest(F.lit(least), px(2, "height") - y).alias("h"))
    return items.select("frame", "ord", F.col("i.original_text").alias("original_text"), F.col("i.translated_text").alias("translated_text"), box.alias("bbox")).filter(strip(F.coalesce("original_text", F.lit(""))) != "")


def clamp(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes (x, y, w, h columns) cut to the frame; empty ones go."""
    inside = lambda v, top: F.greatest(F.lit(0), F.least(v, top))
    x1, y1 = inside(F.col("x"), width), inside(F.col("y"), height)
    x2, y2 = inside(F.col("x") + F.col("w"), width), inside(F.col("y") + F.col("h"), height)
    return boxes.withColumns({"x": x1, "y": y1, "w": x2 - x1, "h": y2 - y1}).filter("w > 0 AND h > 0")


def masks_and_cues(boxes: DataFrame, width: int, height: int, watermarks: list[str]) -> tuple[DataFrame, DataFrame]:
    """(masks, cues): padded boxes of all detections, and the detections without watermarks."""
    x1, y1 = F.greatest(F.lit(0), F.col("x") - 8), F.greatest(F.lit(0), F.col("y") - 4)
    x2, y2 = F.least(F.lit(width), F.col("x") + F.col("w") + 8), F.least(F.lit(height), F.col("y") + F.col("h") + 6)
    masks = boxes.select("frame", "ord", x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))
    term = F.lit(False)
    for mark in watermarks:
        term = term | F.contains(F.lower("text"), F.lit(mark.lower()))
    return masks, boxes.filter(~term)


def unstack_bands(boxes: DataFrame, band_height: int, top: int, bottom: int, width: int, height: int) -> DataFrame:
    """Boxes of a crop of two bands stacked on each other, back in the frame: centres above
    band_height belong to the band at `top`, others to that at `bottom`."""
    upper = F.col("y") + F.col("h") / 2 < band_height
    y = F.when(upper, F.col("y") + top).otherwise(F.col("y") - band_height + bottom)
    return clamp(boxes.withColumn("y", y), F.lit(width), F.lit(height))


def confidence_pct(w: Column, h: Column, conf_pct: Column, width: int) -> Column:
    """Whole percent; 20 for boxes wider than 0.9 of the frame or higher than 150."""
    return F.when((w * 10 > width * 9) | (h > 150), 20).otherwise(conf_pct.cast("int"))


def best_per_frame(det: DataFrame) -> DataFrame:
    """The detection with the highest confidence; the first of equal ones."""
    full = det.filter(strip(F.coalesce("text", F.lit(""))) != "")
    return full.groupBy("frame").agg(F.max(F.struct("conf", (-F.col("ord")).alias("o"), "text")).alias("b")).select("frame", (-F.col("b.o")).alias("ord"), F.col("b.conf").alias("conf"), F.col("b.text").alias("text"))


def best_score(text: Column, conf: Column) -> Column:
    """Aggregate: the best text score of a group of readings."""
    return F.max(text_score(text, conf))


def text_score(text: Column, mean_conf: Column, *, light: bool = False) -> Column:
    """-1 without text, 0 without letters, else length + 1.5 per ideograph + 12 * confidence
    (light: length + 10 * confidence)."""
    clean = F.regexp_replace(text, r"(?U)[^\w\s一-鿿　-〿＀-￯]", "")
    full = F.length(clean) + mean_conf * 10 if light else F.length(clean) + F.regexp_count(clean, F.lit(IDEOGRAPH)) * 1.5 + mean_conf * 12
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(-1.0)).when(strip(clean) == "", F.lit(0.0)).otherwise(full.cast("double"))


def best_variant(scored: DataFrame) -> DataFrame:
    """Per crop the variant (crop, variant, score, ...) with the best score; the first of equal ones."""
    w = W.partitionBy("crop").orderBy(F.desc("score"), "variant")
    return scored.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def cascade(crops: DataFrame, *, force: bool = False) -> DataFrame:
    """The method used for each crop, of columns {a,b,c,d}_{text,conf,score}.

    A is taken at a confidence over 0.40 or three characters; else the better of A and B if
    it has text (A at ties); else the better of C and D (C at ties).
    """
    a_good = F.lit(not force) & ((F.col("a_conf") > 0.40) | (F.length("a_text") >= 3))
    ab = F.when(F.col("b_score") > F.col("a_score"), "b").otherwise("a")
    cd = F.when(F.col("d_score") > F.col("c_score"), "d").otherwise("c")
    return crops.withColumn("method", F.when(a_good, "a").when(F.greatest("a_score", "b_score") > 0, ab).otherwise(cd))


def strip_assembly(regions: DataFrame) -> DataFrame:
    """Upright regions (crop, w, h, full_text) read in slices (slices array<string>): their
    texts joined; the text of the whole region where it is longer."""
    n = F.greatest(F.lit(2), F.bround(F.col("h") / F.col("w"))).cast("int")
    upright = (F.col("h") * 4 > F.col("w") * 5) & (F.col("w") > 10)
    joined = F.array_join(F.slice("slices", F.lit(1), n), "")
    return regions.withColumns({"n_slices": F.when(upright, n), "text": F.when(upright & (F.length(joined) >= F.length("full_text")), joined).otherwise(F.col("full_text"))})


def reading_order(det: DataFrame) -> DataFrame:
    """Adds line and nth: detections (frame, ord, x, y, w, h) by lines, then left to right.

    In order of their centres' height, a box joins the line if its centre is less than 0.6
    of the line's mean height from the centre of the line's first box. A fold over a
    frame's boxes; a frame is the unit of memory.
    """
    box = F.struct((2 * F.col("y") + F.col("h")).alias("cy2"), "ord", "h", (2 * F.col("x") + F.col("w")).alias("cx2"))
    frames = det.groupBy("frame").agg(F.array_sort(F.collect_list(box)).alias("b"))
    none = F.struct(F.array().cast("array<struct<line:int,cx2:int,ord:int>>").alias("out"), F.lit(0).alias("line"), F.lit(0).alias("first"), F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("n"))

    def step(s, x):
        # |cy - first| < 0.6 * sum / n, on doubled centres and without fractions
        same = (s["n"] > 0) & (F.abs(x["cy2"] - s["first"]) * 10 * s["n"] < 12 * s["sum"])
        line = F.when(same, s["line"]).otherwise(s["line"] + 1)
        return F.struct(
            F.concat(s["out"], F.array(F.struct(line.alias("line"), x["cx2"].alias("cx2"), x["ord"].alias("ord")))).alias("out"), line.alias("line"),
            F.when(same, s["first"]).otherwise(x["cy2"]).alias("first"), F.when(same, s["sum"] + x["h"]).otherwise(x["h"]).cast("bigint").alias("sum"), F.when(same, s["n"] + 1).otherwise(1).alias("n"),
        )

    placed = frames.select("frame", F.posexplode(F.array_sort(F.aggregate("b", none, step, lambda s: s["out"]))).alias("nth", "p"))
    return placed.select("frame", F.col("p.ord").alias("ord"), F.col("p.line").alias("line"), "nth")


def frame_text(det: DataFrame) -> DataFrame:
    """(frame, text): the texts of a frame in reading order, joined by spaces."""
    order = reading_order(det)
    j = det.join(order.hint("merge"), ["frame", "ord"]).filter(strip(F.coalesce("text", F.lit(""))) != "")
    return j.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("nth", "text"))).alias("t")).select("frame", F.array_join(F.col("t.text"), " ").alias("text"))


def change_reuse(samples: DataFrame, *, keys: tuple[str, ...] = ("media_id",), change: float = 5.5, flat: float | None = 3.5, scale: float = 1.0, piece_bits: int | None = None) -> DataFrame:
    """(keys, ord, action, source_ord): samples (keys, ord, feat array<float>) that need reading.

    A sample within `change` (mean absolute difference) of the last kept one of its keys reuses it; a flat one
    (deviation under `flat`; None: no such rule) is empty; others are read and kept. A sample whose
    feature is null, or has another length than the kept one, is never within it; a null one is not flat either.

    With keys medium, box and mode this is the reuse of masked crops, each box for itself. A medium of any
    size is folded in pieces (see resume.folded): a sample that is read forgets all before it.
    """

    def fold(table: pa.Table, state: bytes | None) -> tuple[pa.Table, bytes]:
        feats, ords = table["feat"].to_pylist(), table["ord"].to_pylist()
        source = kept = None
        if state:
            number, _, held = state.partition(b"|")
            source, kept = int(number), np.frombuffer(held, np.float32)
        actions, sources = [], []
        for ord_, feat in zip(ords, feats):
            x = None if feat is None else np.array(feat, np.float32)
            if x is not None and kept is not None and len(x) == len(kept) and len(x) and _total(np.abs(kept - x)) / len(x) * scale < change:
                actions.append("reuse")
                sources.append(source)
                continue
            if flat is not None and x is not None and len(x) and _deviation(x) * scale < flat:
                actions.append("empty")
                sources.append(None)
                continue
            kept, source = (np.empty(0, np.float32) if x is None else x), ord_
            actions.append("read")
            sources.append(ord_)
        out = pa.table({**{k: table[k] for k in keys}, "ord": table["ord"], "action": actions, "source_ord": pa.array(sources, pa.int64())})
        return out, b"" if kept is None else str(source).encode() + b"|" + kept.tobytes()

    rows = samples.select(*keys, F.col("ord").cast("bigint").alias("ord"), F.col("feat").cast("array<float>").alias("feat"))
    kinds = "".join(f"`{k}` {samples.schema[k].dataType.simpleString()}, " for k in keys)
    return folded(rows, list(keys), ["ord"], fold, kinds + "ord bigint, action string, source_ord bigint", piece_bits=piece_bits).drop("_piece")


def _total(x: np.ndarray) -> float:
    """Sum from left to right in double precision."""
    return float(np.cumsum(x, dtype=np.float64)[-1])


def _deviation(x: np.ndarray) -> float:
    d = x.astype(np.float64) - _total(x) / len(x)
    return float(np.sqrt(_total(d * d) / len(x)))
