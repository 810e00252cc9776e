"""Subtitle files as a Spark data source: read into cue rows, written from sorted parts.

A reader takes files of some total size a task and parses them line by line; a writer streams the parts of one
medium after another to their files. Neither holds more than a file's bytes or a batch of rows.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cuelake.functions.time import TIMECODE
from cuelake.operators.shared import opened

#: Bytes of the files of a task aimed at.
TASK_BYTES = 64 << 20
#: White space as column expressions strip it.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_CODE = re.compile(TIMECODE, re.ASCII)
CUES = "path string, ord bigint, start_ms bigint, end_ms bigint, text string"


def _ms(code: str) -> int:
    h, m, s, f = re.split("[:,.]", code)
    return ((int(h) * 60 + int(m)) * 60 + int(s)) * 1000 + int(f.ljust(3, "0"))


def cues_of(lines: Iterable[str]) -> Iterator[tuple[int, int, int, str]]:
    """(ord, start_ms, end_ms, text) of the lines of a file, by the rules of subtitles.parse_srt, a cue at a time."""
    ord_, times, body = 0, None, None  # body: None once the text has ended
    ahead = chain((x.strip(_BLANK) for x in lines), [""])
    line = next(ahead)
    for after in ahead:
        codes = _CODE.findall(line) if "-->" in line else []
        if len(codes) >= 2:
            if times:
                yield ord_, *times, " ".join(kept)
            ord_, times, body = ord_ + 1, (_ms(codes[0]), _ms(codes[1])), []
            kept = body
        elif body is not None:
            if not line or "-->" in line or (re.fullmatch(r"\d+", line) and "-->" in after):
                body = None
            else:
                body.append(line)
        line = after
    if times:
        yield ord_, *times, " ".join(kept)


def decoded(content: bytes) -> str:
    """UTF-16 by its BOM, UTF-8 (BOM dropped), else Latin-1, as subtitles.decode_bytes."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace")
    try:
        return content.decode("utf-8-sig")
    except UnicodeError:
        return content.decode("latin-1")


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def partitions(self) -> list[Files]:
        import pyarrow.fs as fs

        system, at = opened(self.path)
        found = system.get_file_info(fs.FileSelector(at, recursive=True))
        groups, held = [[]], 0
        for f in sorted((f for f in found if f.is_file and f.path.endswith(self.suffix)), key=lambda f: f.path):
            if held and held + f.size > TASK_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(f.path)
            held += f.size
        return [Files(tuple(g)) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names, rows = [c.split()[0] for c in CUES.split(", ")], []
        for name in partition.names:
            with system.open_input_stream(name) as f:
                text = decoded(f.read())
            for cue in cues_of(re.split(r"\r\n|\r|\n", text)):
                rows.append((name, *cue))
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    folder: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix, self.staging = path, suffix, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows (name, part), those of a name together. A task that is run again writes a folder of its own."""
        system, at = opened(self.path)
        folder = f"{at}/{self.staging}/{uuid.uuid4().hex}"
        system.create_dir(folder)
        names, out = [], None
        try:
            for batch in iterator:
                for name, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if out is None or name != names[-1]:
                        if out:
                            out.close()
                        if not re.fullmatch(r"[^/\\]+", name or "") or name in (".", ".."):
                            raise ValueError(f"not a file name: {name!r}")
                        out = system.open_output_stream(f"{folder}/{name}{self.suffix}")
                        names.append(name)
                    out.write((part or "").encode())
        finally:
            if out:
                out.close()
        if len(set(names)) < len(names):
            raise ValueError("parts of one file are not together")
        return Written(names, folder)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = opened(self.path)
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{m.folder}/{name}{self.suffix}", f"{at}/{name}{self.suffix}")
        system.delete_dir(f"{at}/{self.staging}")

    def abort(self, messages: list[Written | None]) -> None:
        system, at = opened(self.path)
        system.delete_dir_contents(f"{at}/{self.staging}", missing_dir_ok=True)


class CueFiles(DataSource):
    """Format `cuefiles`: reads SRT cues (CUES), writes (name, part); option suffix, .srt by default."""

    @classmethod
    def name(cls) -> str:
        return "cuefiles"

    def schema(self) -> str:
        return CUES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("suffix", ".srt"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("suffix", ".srt"))


def read(spark: SparkSession, path: str, suffix: str = ".srt") -> DataFrame:
    """Cues (path, ord, start_ms, end_ms, text) of all files below path, in the encodings of decoded()."""
    spark.dataSource.register(CueFiles)
    return spark.read.format("cuefiles").option("suffix", suffix).load(path)


def save(parts: DataFrame, path: str, suffix: str = ".srt") -> None:
    """A file a medium from parts (media_id, n, part), in the order of n. Files of the same name are replaced, once all are written."""
    parts.sparkSession.dataSource.register(CueFiles)
    dealt = parts.repartition("media_id").sortWithinPartitions("media_id", "n")
    named = dealt.selectExpr("CAST(media_id AS STRING) AS name", "part")
    named.write.format("cuefiles").option("suffix", suffix).mode("append").save(path)
