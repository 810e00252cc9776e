"""Cue building whose breaks depend on the texts: time cuts first, then a small fold.

A gap that no text could bridge ends an island for certain. Islands are dealt out by their
key and sorted; a task streams many of them through one Arrow call and holds one open cue.
"""
from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.functions.similarity import alike, overlap_merge, reaches, similarity_from
from cuelake.functions.text import strip
from cuelake.operators.resume import folded as in_pieces
from cuelake.operators.cues import BEFORE, SO_FAR, drop_brief, drop_degenerate, drop_short_noise, media_order, with_islands

#: Rows of an Arrow batch of results.
OUT_ROWS = 10_000
CUE = "media_id bigint, ord bigint, start_ms bigint, end_ms bigint, text string"
BOXED = CUE + ", x int, y int, w int, h int"


@dataclass(frozen=True)
class Cue:
    ord: int
    start: int
    end: int
    text: str
    box: tuple | None = None

    def grown(self, other: Cue, text: str) -> Cue:
        return replace(self, end=max(self.end, other.end), text=text, box=hull(self.box, other.box))


def hull(a: tuple | None, b: tuple | None) -> tuple | None:
    if a is None or b is None:
        return a or b
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y


def folded(rows: DataFrame, island: str, order: list[Column], columns: list[str], fold: Callable[[Iterator[tuple]], Iterable[Cue]], schema: str) -> DataFrame:
    """Cues that fold() makes of the rows of each (media_id, island), in order, as `schema`.

    fold() gets an iterator over tuples of `columns` and may yield as it goes, so neither
    an island nor a medium is gathered.
    """
    keyed = rows.select("media_id", F.col(island).alias("_island"), *columns, *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    names = [f"_o{i}" for i in range(len(order))]
    dealt = keyed.repartition("media_id", "_island").sortWithinPartitions("media_id", "_island", *names).drop(*names)
    fields = [f.split(" ") for f in schema.split(", ")]
    kinds = [(name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]) for name, kind in fields]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*out), kinds)], names=[n for n, _ in kinds])

    def run(batches):
        out, boxed = [], len(kinds) > 5
        every = (row for b in batches for row in zip(*(b[c].to_pylist() for c in b.schema.names)))
        for (medium, _), group in groupby(every, key=lambda row: row[:2]):
            for c in fold(row[2:] for row in group):
                out.append((medium, c.ord, c.start, c.end, c.text, *((c.box or (None,) * 4) if boxed else ())))
                if len(out) == OUT_ROWS:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return dealt.mapInArrow(run, schema)


def merge_by_strategy(cues: DataFrame, strategy: str = "combine", gap_ms: int = 80, least: float = 0.78) -> DataFrame:
    """Merge the cues of each time island: `prefer_longest`, `prefer_first`, or `combine` (the
    overlap of the texts). Of similar neighbours the longer text stays in any case."""
    if strategy not in ("combine", "prefer_first", "prefer_longest"):
        raise ValueError(f"no such strategy: {strategy}")

    def fold(rows):
        cue = None
        for ord, start, end, text in rows:
            nxt = Cue(ord, start, end, text or "")
            if cue is None:
                cue = nxt
            elif strategy == "prefer_longest" or alike(cue.text, nxt.text, least):
                cue = cue.grown(nxt, longer(cue.text, nxt.text))
            else:
                cue = cue.grown(nxt, overlap_merge(cue.text, nxt.text) if strategy == "combine" else cue.text)
        yield cue

    order = [F.col("start_ms"), F.col("start_ms") - F.col("end_ms"), F.col("ord")]
    return drop_degenerate(folded(with_islands(cues, gap_ms), "island", order, ["ord", "start_ms", "end_ms", "text"], fold, CUE))


def same_line(a: str, b: str, least: float) -> bool:
    """Similar enough or one within the other; placeholders are never the same line."""
    a, b = a.strip().lower(), b.strip().lower()
    return not ("[chữ khó" in a or "[chữ khó" in b) and (a in b or b in a or reaches(a, b, least))


def joins_overlap(cur: Cue, nxt: Cue, overlap_ms: int, least: float, longest_ms: int = 8_000) -> bool:
    return nxt.start - cur.end <= overlap_ms + 300 and cur.end - cur.start < longest_ms and same_line(cur.text, nxt.text, least)


def longer(a: str, b: str) -> str:
    return b if len(b) > len(a) else a


def box_of(*edges) -> tuple | None:
    return None if edges[0] is None else edges


def with_boxes(rows: DataFrame) -> DataFrame:
    return rows if "x" in rows.columns else rows.withColumns({c: F.lit(None).cast("int") for c in "xywh"})


def dedupe_overlap(cues: DataFrame, overlap_ms: int = 1_500, least: float = 0.80) -> DataFrame:
    """Cues of overlapping chunks without the lines found twice; boxes (x, y, w, h) joined.

    A start later than everything before plus the overlap and 300 ms always ends a cue, so
    islands at that gap hold whole answers.
    """

    def fold(rows):
        cue = None
        for ord, start, end, text, *box in rows:
            nxt = Cue(ord, start, end, text, box_of(*box))
            if cue and joins_overlap(cue, nxt, overlap_ms, least):
                cue = cue.grown(nxt, longer(cue.text, nxt.text))
            else:
                if cue:
                    yield cue
                cue = nxt
        yield cue

    kept = drop_short_noise(with_boxes(cues)).select("media_id", "ord", "start_ms", "end_ms", "text", "x", "y", "w", "h")
    order = [F.col("start_ms"), F.col("ord")]
    islands = with_islands(kept, overlap_ms + 300, order)
    return folded(islands, "island", order, ["ord", "start_ms", "end_ms", "text", "x", "y", "w", "h"], fold, BOXED)


@dataclass
class Sampler:
    """Turns samples of one medium, in order, into cues; `open` is the cue not yet closed."""

    hold_ms: int
    miss_ms: int
    longest_ms: int
    least: float
    open: Cue | None = None
    seen: int = 0

    def take(self, ord: int, t: int, text: str, stop: int, box: tuple | None = None) -> list[Cue]:
        """The cues that this sample closes."""
        here = Cue(ord, t, min(t + self.hold_ms, stop), text, box)
        recent = self.open is not None and t - self.seen <= self.miss_ms and t - self.open.start < self.longest_ms
        if not text:
            if recent:
                self.open = replace(self.open, end=here.end)
                return []
            return self.close()
        legible = "[Chữ khó" not in text and "Gemini" not in text
        if recent and legible and alike(self.open.text, text, self.least):
            size = lambda x: len(" ".join(x.split()))
            best = text if size(text) > size(self.open.text) else self.open.text
            self.open, self.seen = replace(self.open, end=here.end, text=best, box=hull(self.open.box, box)), t
            return []
        closed = self.close()
        self.open, self.seen = here, t
        return closed

    def close(self) -> list[Cue]:
        closed, self.open = [self.open] if self.open else [], None
        return closed


def sampled_cues(frames: DataFrame, *, hold_ms: int = 1_500, miss_ms: int = 1_200, longest_ms: int = 8_000, least: float = 0.78, brief: bool = False) -> DataFrame:
    """Cues of sampled frames (media_id, ord, t_ms, text, duration_ms, and boxes x, y, w, h if
    there are any); an empty text is a miss.

    A similar, legible text within miss_ms of the last one extends the open cue (up to
    longest_ms of age), as does a miss; anything else closes it. Each sighting holds for
    hold_ms, within the medium; a cue's box holds those of its sightings. With miss_ms=0
    an empty sample closes the cue. Cues that are too brief for their text go at the end
    (see cues.drop_brief), unless brief=True.

    Cut: a text more than miss_ms after the last text always opens a cue; empty samples
    stay with the island before them.
    """

    def fold(rows):
        machine = Sampler(hold_ms, miss_ms, longest_ms, least)
        for ord, t, text, stop, *box in rows:
            yield from machine.take(ord, t, text or "", stop, box_of(*box))
        yield from machine.close()

    order = [F.col("t_ms"), F.col("ord")]
    w = media_order("t_ms", "ord")
    full = F.when(F.coalesce("text", F.lit("")) != "", F.col("t_ms"))
    cut = (full - F.max(full).over(w.rowsBetween(*BEFORE)) > miss_ms).cast("int")
    islands = with_boxes(frames).withColumn("island", F.sum(F.coalesce(cut, F.lit(0))).over(w.rowsBetween(*SO_FAR)))
    made = folded(islands, "island", order, ["ord", "t_ms", "text", "duration_ms", "x", "y", "w", "h"], fold, BOXED)
    return made if brief else tidied(made)


def tidied(cues: DataFrame) -> DataFrame:
    """Stripped texts; blank and too brief cues go."""
    return drop_brief(cues.withColumn("text", strip(F.col("text"))).filter("text <> ''"))


def consecutive_similar(frames: DataFrame, *, hold_ms: int = 1_500, least: float = 0.78, piece_bits: int | None = None) -> DataFrame:
    """As sampled_cues, but an empty sample always closes the cue and age does not matter: only the texts can
    end a cue, so its rows are folded in pieces (see resume.folded) and added up."""

    def fold(table: pa.Table, state: bytes | None) -> tuple[pa.Table, bytes]:
        head, text = json.loads(state) if state else (None, "")
        heads, texts = [], []
        for t, o, own in zip(*(table[c].to_pylist() for c in ("t_ms", "ord", "text"))):
            if not own:
                head, text = None, ""
            elif head is not None and alike(text, own, least):
                text = longer(text, own)
            else:
                head, text = (t, o), own
            heads.append(head or (None, None))
            texts.append(text)
        return _headed(table, ["media_id", "t_ms", "ord"], heads, text=texts), json.dumps([head, text]).encode()

    # by medium, empty samples included: most runs between those are some rows only, and a group has a cost of its own
    rows = frames.select("media_id", F.col("t_ms").cast("bigint").alias("t_ms"), F.col("ord").cast("bigint").alias("ord"), "text")
    made = in_pieces(rows, ["media_id"], ["t_ms", "ord"], fold, "media_id bigint, t_ms bigint, ord bigint, text string, head_t bigint, head_ord bigint", piece_bits=piece_bits).filter("head_ord IS NOT NULL")
    cues = made.groupBy("media_id", "head_t", "head_ord").agg(F.max("t_ms").alias("t"), F.max_by("text", F.struct("t_ms", "ord")).alias("text"))
    return cues.select("media_id", F.col("head_ord").alias("ord"), F.col("head_t").alias("start_ms"), (F.col("t") + hold_ms).alias("end_ms"), "text")


def _headed(table: pa.Table, columns: list[str], heads: list[list[int]], **more: list) -> pa.Table:
    """Rows of a piece with (t_ms, ord) of the row that began their cue."""
    t, o = zip(*heads) if heads else ((), ())
    return pa.table({**{c: table[c] for c in columns}, **more, "head_t": pa.array(t, pa.int64()), "head_ord": pa.array(o, pa.int64())})


def consecutive_either(detections: DataFrame, interval_ms: int = 1_500, lead_in_ms: int = 200, *, piece_bits: int | None = None) -> DataFrame:
    """Cues of consecutive detections (media_id, t_ms, ord, text, trans, x, y, w, h) that share
    the text or the translation of the cue's first one; text is that translation, and the
    box is the first one's. Time has no bound: a medium is folded in pieces (see resume.folded)."""

    def fold(table: pa.Table, state: bytes | None) -> tuple[pa.Table, bytes]:
        head, first = json.loads(state) if state else (None, None)
        heads = []
        for t, o, text, trans in zip(*(table[c].to_pylist() for c in ("t_ms", "ord", "text", "trans"))):
            if head is None or not (first[0] == text or first[1] == trans):
                head, first = [t, o], [text, trans]
            heads.append(head)
        return _headed(table, ["media_id", "t_ms", "ord", "trans", *"xywh"], heads), json.dumps([head, first]).encode()

    rows = with_boxes(detections).select("media_id", F.col("t_ms").cast("bigint").alias("t_ms"), F.col("ord").cast("bigint").alias("ord"), "text", "trans", *[F.col(c).cast("int").alias(c) for c in "xywh"])
    made = in_pieces(rows, ["media_id"], ["t_ms", "ord"], fold, "media_id bigint, t_ms bigint, ord bigint, trans string, x int, y int, w int, h int, head_t bigint, head_ord bigint", piece_bits=piece_bits)
    order = F.struct("t_ms", "ord")
    cues = made.groupBy("media_id", "head_t", "head_ord").agg(F.max("t_ms").alias("t"), F.min_by(F.struct("trans", *"xywh"), order).alias("f"))
    return cues.select("media_id", F.col("head_ord").alias("ord"), F.greatest(F.col("head_t") - lead_in_ms, F.lit(0)).alias("start_ms"), (F.col("t") + interval_ms).alias("end_ms"), F.col("f.trans").alias("text"), *[F.col(f"f.{c}").alias(c) for c in "xywh"])


def residual_duplicates(cues: DataFrame, gap_ms: int = 2_500, least: float = 0.85) -> DataFrame:
    """Neighbouring cues that still hold one line: close in time, over two characters, alike."""
    w = W.partitionBy("media_id").orderBy("start_ms", "ord")
    pairs = cues.withColumns({"next_text": F.lead("text").over(w), "next_start": F.lead("start_ms").over(w)}).filter(
        (F.col("next_start") - F.col("end_ms") <= gap_ms) & (F.length("text") > 2) & (F.length("next_text") > 2)
    )
    return pairs.withColumn("ratio", similarity_from(F.col("text"), F.col("next_text"), least)).filter("ratio IS NOT NULL").select("media_id", "ord", "text", "next_text", "ratio")
