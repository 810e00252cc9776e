"""Cues on Structured Streaming: ingestion, stateful merging, sessions, late rows, progress."""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuelake.operators.cues import drop_short_noise
from cuelake.operators.folds import Cue, Sampler, box_of, joins_overlap, longer, with_boxes

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN = "ord bigint, start_ms bigint, end_ms bigint, text string, x int, y int, w int, h int, seen_ms bigint"
OUT = "media_id bigint, ord bigint, start_ms bigint, end_ms bigint, text string, x int, y int, w int, h int, late boolean"
#: Rows that are packed at once.
PACKED_ROWS = 200_000


def read_stream(spark: SparkSession, path: str, schema: str, *, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder, in batches; where it stopped is kept by the checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append a stream to out, a folder a batch: a batch that is run again replaces its own
    folder, so every row is there once. Ends when all available input is taken."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write all available input of a stream to Parquet in out."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def packed(rows: DataFrame) -> DataFrame:
    """A row a medium with an array of each other column, in place of up to PACKED_ROWS rows.

    What the state takes and gives is turned into Python values cell by cell, at a cost of some
    microseconds each; an array is one cell.
    """
    columns = rows.drop("media_id").columns

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED_ROWS:
                yield pa.Table.from_batches(held)
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in slabs(batches):
            made = table.group_by("media_id", use_threads=False).aggregate([(c, "list") for c in columns])
            yield from made.select(["media_id", *[f"{c}_list" for c in columns]]).rename_columns(["media_id", *columns]).to_batches()

    dealt = rows.select("media_id", *columns).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "media_id")
    return dealt.mapInArrow(pack, ", ".join(f"{f.name} {f.dataType.simpleString()}" if f.name == "media_id" else f"{f.name} array<{f.dataType.simpleString()}>" for f in dealt.schema))


def _with_state(rows: DataFrame, processor: StatefulProcessor, schema: str, time: str) -> DataFrame:
    """Rows of schema that a processor makes of packed rows; it gives them packed, see _rows."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    key, *columns = (c.split() for c in schema.split(", "))
    arrays = ", ".join([" ".join(key), *[f"{name} array<{kind}>" for name, kind in columns]])
    made = packed(rows).groupBy("media_id").transformWithState(processor, outputStructType=arrays, outputMode="append", timeMode=time)
    return made.select("media_id", F.inline(F.arrays_zip(*[name for name, _ in columns])))


def _rows(schema: str, key: tuple, columns: Iterable[tuple]) -> Row:
    """A row of arrays: tuples, which Spark does not copy item by item as it does lists."""
    return Row(*[c.split()[0] for c in schema.split(", ")])(key[0], *columns)


class _CueProcessor(StatefulProcessor):
    """The open cue of a medium and the latest start seen. Rows behind that start, or behind the watermark, come out as
    they are, with late = true; a cue comes out when a row closes it or its timer expires."""

    #: Columns after media_id, the first two in order; x, y, w, h and base_ms follow.
    taken: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)
        self.latest = handle.getValueState("latest", "at bigint")

    def rows(self, key, cues: Iterable[tuple[Cue, bool]]) -> Iterator[Row]:
        made = [(c.ord, c.start, c.end, c.text, *(c.box or (None,) * 4), late) for c, late in cues]
        if made:
            yield _rows(OUT, key, zip(*made))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        own = [item for row in rows for item in zip(*row[1:])]
        base = own[-1][-1]
        own.sort(key=itemgetter(0, 1))
        found = self.latest.get()
        latest = found[0] if found else None
        held, seen = self.held() if found else (None, 0)
        yield from self.rows(key, self.take(self.in_order(own, latest, timerValues.getCurrentWatermarkInMs()), held, seen))
        self.latest.update((own[-1][0] if latest is None else max(latest, own[-1][0]),))
        self.hold(held, base)

    def in_order(self, own: list[tuple], latest: int | None, watermark: int) -> Iterator[tuple[tuple, bool]]:
        """Rows by time, each with whether it is late."""
        for row in own:
            t = row[0]
            late = (latest is not None and t < latest) or (watermark > 0 and t + row[-1] <= watermark)
            latest = t if latest is None else max(latest, t)
            yield row, late

    def held(self) -> tuple[Cue | None, int]:
        found = self.open.get()
        if not found:
            return None, 0
        ord, start, end, text, x, y, w, h, seen = found
        return Cue(ord, start, end, text, None if x is None else (x, y, w, h)), seen

    def hold(self, was: Cue | None, base: int) -> None:
        """Keep what take() left open, with one timer: a medium has one while it has an open cue."""
        cue, seen, expires = self.left
        if was:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if cue is None:
            if was:
                self.open.clear()
            return
        self.open.update((cue.ord, cue.start, cue.end, cue.text, *(cue.box or (None,) * 4), seen))
        self.handle.registerTimer(base + expires)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        cue, _ = self.held()
        if cue:
            self.open.clear()
        yield from self.rows(key, [(cue, False)] if cue else [])

    def close(self) -> None:
        pass


class _Merger(_CueProcessor):
    """See folds.dedupe_overlap."""

    taken = ("start_ms", "ord", "end_ms", "text")

    def __init__(self, overlap_ms: int, least: float):
        self.overlap_ms, self.least = overlap_ms, least

    def take(self, rows: Iterable[tuple[tuple, bool]], cue: Cue | None, seen: int) -> Iterator[tuple[Cue, bool]]:
        for (start, ord, end, text, *box, _), late in rows:
            nxt = Cue(ord, start, end, text, box_of(*box))
            if late:
                yield nxt, True
            elif cue and joins_overlap(cue, nxt, self.overlap_ms, self.least):
                cue = cue.grown(nxt, longer(cue.text, nxt.text))
            else:
                if cue:
                    yield cue, False
                cue = nxt
        self.left = cue, 0, (cue.end if cue else 0) + self.overlap_ms + 300


class _SampleProcessor(_CueProcessor):
    """See folds.sampled_cues; silence closes the open cue by an event-time timer."""

    taken = ("t_ms", "ord", "text", "duration_ms")

    def __init__(self, hold_ms: int, miss_ms: int, longest_ms: int, least: float):
        self.args, self.miss_ms = (hold_ms, miss_ms, longest_ms, least), miss_ms

    def take(self, rows: Iterable[tuple[tuple, bool]], cue: Cue | None, seen: int) -> Iterator[tuple[Cue, bool]]:
        machine = Sampler(*self.args)
        machine.open, machine.seen = cue, seen
        for (t, ord, text, stop, *box, _), late in rows:
            text = text or ""
            if not late:
                for closed in machine.take(ord, t, text, stop, box_of(*box)):
                    yield closed, False
            elif text:
                yield Cue(ord, t, min(t + machine.hold_ms, stop), text, box_of(*box)), True
        self.left = machine.open, machine.seen, machine.seen + self.miss_ms + 1


def _processed(rows: DataFrame, processor: _CueProcessor, clock: str, watermark: str) -> DataFrame:
    # Spark drops rows behind the watermark from what holds the event-time column: without it they reach the processor
    rows = with_boxes(rows).withWatermark("ts", watermark).select("media_id", *processor.taken, *"xywh", (F.unix_millis("ts") - F.col(clock)).alias("base_ms"))
    return _with_state(rows, processor, OUT, "EventTime")


def sample_stream(stream: DataFrame, *, hold_ms: int = 1_500, miss_ms: int = 1_200, longest_ms: int = 8_000, least: float = 0.78, watermark: str = "30 seconds") -> DataFrame:
    """Cues of a stream of samples (media_id, ord, t_ms, text, duration_ms, ts); see
    folds.sampled_cues with brief=True. State is one open cue a medium, closed by the next
    text or by miss_ms of silence on the event clock. Samples behind the last one of their
    medium come out as cues of their own, with late = true, and change nothing: the result
    equals the batch form for input in order, with what still_open gives at the end."""
    return _processed(stream, _SampleProcessor(hold_ms, miss_ms, longest_ms, least), "t_ms", watermark)


def dedupe_stream(stream: DataFrame, overlap_ms: int = 1_500, least: float = 0.80, watermark: str = "30 seconds") -> DataFrame:
    """Overlap dedupe of a stream of cues (media_id, ord, start_ms, end_ms, text, ts).

    ts is event time: start_ms after some base that a medium keeps. State is one open cue a medium; a cue goes
    out when the next one breaks it or the watermark passes its reach. Rows behind the
    last start seen of their medium come out as they are, with late = true: the result
    equals the batch operator for input in order, with what still_open gives at the end.
    """
    return _processed(drop_short_noise(stream), _Merger(overlap_ms, least), "start_ms", watermark)


def still_open(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Cues that a drained sample_stream or dedupe_stream still holds, as its output rows."""
    state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    return state.select("key.*", "value.*", F.lit(False).alias("late")).drop("seen_ms")


def sessions(stream: DataFrame, overlap_ms: int = 1_500, watermark: str = "30 seconds") -> DataFrame:
    """Cues per medium chained by time, batch or stream: a session lasts while cues start
    within the duration of one plus the overlap and 300 ms, or just at its end.

    In append mode a session comes out once, when the watermark passes its end, and its state goes;
    open_sessions has those that still wait. Rows behind the watermark are dropped: see mark_behind.
    """
    gap = F.concat((F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)) + overlap_ms + 300).cast("string"), F.lit(" milliseconds"))
    rows = stream.withWatermark("ts", watermark) if stream.isStreaming else stream
    grouped = rows.groupBy("media_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.max("end_ms").alias("end_ms"))
    return grouped.select("media_id", F.unix_millis("s.start").alias("start_ms"), "end_ms", "n")


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Sessions that a drained stream of sessions still holds, as its output rows."""
    v = F.col("value")
    return spark.read.format("statestore").load(checkpoint).select(v["media_id"].alias("media_id"), F.unix_millis(v["session_window"]["start"]).alias("start_ms"), v["max"].alias("end_ms"), v["count"].alias("n"))


def progress(stream: DataFrame) -> DataFrame:
    """Latest state of each job and its number of events. In update mode a batch gives the jobs that it
    changes: KeyedTable.follow keeps them."""
    return stream.groupBy("job_id").agg(F.max_by("state", F.struct("ts_ms", "event_id")).alias("state"), F.count("*").alias("n"))


BEHIND = "media_id bigint, ord bigint, start_ms bigint, end_ms bigint, text string, late boolean, behind_ms bigint"


class _Behind(StatefulProcessor):
    """The latest event time of a medium, until the watermark is keep_ms past it. The timer of a medium that goes on
    is left until it expires and set again then."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        found = self.latest.get()
        held = top = found[0] if found else None
        for row in rows:
            top = max((t for t in (top, *row.at_ms) if t is not None), default=None)
            late = (t is not None and 0 < watermark >= t for t in row.at_ms)
            behind = (0 if held is None or t is None else max(held - t, 0) for t in row.at_ms)
            yield _rows(BEHIND, key, map(tuple, (row.ord, row.start_ms, row.end_ms, row.text, late, behind)))
        if top != held:
            self.latest.update((top,))
            if held is None:
                self.handle.registerTimer(top + self.keep_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ends = self.latest.get()[0] + self.keep_ms
        if ends > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(ends)
        else:
            self.latest.clear()
        yield from ()

    def close(self) -> None:
        pass


def mark_behind(stream: DataFrame, watermark: str, keep_ms: int = 86_400_000) -> DataFrame:
    """Adds late and behind_ms to a stream of cues (media_id, ord, start_ms, end_ms, text, ts) on event time.

    A row is late if its ts is at or behind the watermark: the latest ts of all earlier batches less the delay.
    behind_ms is how far it is behind the latest ts that its medium had in earlier batches (0 if it is not).
    State is one time a medium and goes once the watermark is keep_ms past it. No row is dropped.
    """
    rows = stream.withWatermark("ts", watermark).withColumn("at_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return _with_state(rows.select("media_id", "ord", "start_ms", "end_ms", "text", "at_ms"), _Behind(keep_ms), BEHIND, "EventTime")


LATE = "media_id bigint, ord bigint, start_ms bigint, end_ms bigint, text string, late boolean"


class _LateMarker(StatefulProcessor):
    """The running latest start of a medium."""

    def __init__(self, watermark_ms: int):
        self.watermark_ms = watermark_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "at bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        own = sorted((item for row in rows for item in zip(*row[1:])), key=lambda item: (item[0] is not None, item[0] or 0))
        found, made = self.latest.get(), []
        top = held = found[0] if found else None
        for item in own:
            start = item[1]
            made.append((*item, None not in (start, top) and start < top - self.watermark_ms))
            top = max((t for t in (top, start) if t is not None), default=None)
        if top != held:
            self.latest.update((top,))
        yield _rows(LATE, key, zip(*made))

    def close(self) -> None:
        pass


def mark_late(stream: DataFrame, watermark_ms: int) -> DataFrame:
    """Adds late to cues (media_id, ord, start_ms, end_ms, text), batch or stream: rows
    further behind the running latest start of their medium, in the order of ord, than
    allowed. A stream's batches follow one another in that order."""
    if not stream.isStreaming:
        w = W.partitionBy("media_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
        return stream.withColumn("late", F.coalesce(F.col("start_ms") < F.max("start_ms").over(w) - watermark_ms, F.lit(False)))
    return _with_state(stream.select("media_id", "ord", "start_ms", "end_ms", "text"), _LateMarker(watermark_ms), LATE, "None")


def split_late(stream: DataFrame, watermark_ms: int, on_time: str, late: str, checkpoint: str) -> None:
    """Write rows in time (see mark_late) to one table and late ones to a side table, a folder a batch."""
    split_rows(mark_late(stream, watermark_ms), on_time, late, checkpoint)


def split_rows(marked: DataFrame, on_time: str, late: str, checkpoint: str) -> None:
    """Write the rows of a stream that are not late to one table and the late ones to another, a folder a batch."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.persist()
        for keep, path in ((~F.col("late"), on_time), (F.col("late"), late)):
            rows.filter(keep).drop("late").write.mode("overwrite").parquet(f"{path}/batch={batch}")
        rows.unpersist()

    marked.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
