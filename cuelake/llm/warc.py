"""WARC archives: writing records and assembling them into captures."""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.llm.common import stage_path, staged

#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 100
#: Rows of `pages` in one archive file, at most.
FILE_ROWS = 2_000
CRLF = "\r\n"
#: Where archives are cut. Its first byte comes once, so that a reader with a buffer needs no
#: way back to bytes before the buffer.
SEPARATOR = b"\nWARC/"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record as text, without the two line ends that close it."""
    lines = [F.lit("WARC/1.1")]
    for name, value in headers:
        lines.append(F.concat(F.lit(f"{name}: "), value))  # a null value leaves the header out
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_warc(pages: DataFrame, path: str, *, min_revisit: int = MIN_REVISIT, file_rows: int = FILE_ROWS) -> None:
    """Write request, response or revisit, and metadata records of every page.

    The payload is html in UTF-8 (null: empty). Of equal payloads of at least `min_revisit`
    bytes the smallest page_id is the response; the others are revisits that refer to it
    and carry no payload. The records of a row are made together, in one file, and name the
    response or revisit in WARC-Concurrent-To. Text files with the record's closing line
    ends as separator are WARC files byte for byte (compressed as a whole), and Spark commits them
    task by task.

    Rows that repeat a page_id are numbered and keep records of their own; a null page_id
    takes part as one more id, after all others.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns(
        {"_id": F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "digest": F.sha2("html", 256), "bytes": F.octet_length("html")}
    )
    big = rows.filter(F.col("bytes") >= min_revisit).select("page_id", "_id", "digest").distinct()
    owners = big.groupBy("digest").agg(F.min(F.struct(F.isnull("page_id"), "page_id", "_id"))["_id"].alias("owner"))
    owned = big.join(owners.hint("merge"), "digest").select("_id", "digest", "owner")
    rows = rows.join(owned.hint("merge"), ["_id", "digest"], "left").withColumn(
        "nth", F.row_number().over(W.partitionBy("_id", "digest").orderBy("url"))
    )
    revisit = F.col("owner").isNotNull() & ((F.col("owner") != F.col("_id")) | (F.col("nth") > 1))
    urn = lambda page, nth: F.concat(F.lit("<urn:page:"), page, F.lit(":"), F.substring("digest", 1, 16), F.lit(":"), nth.cast("string"))
    name = urn(F.col("_id"), F.col("nth"))
    rid = F.concat(name, F.when(revisit, F.lit(":revisit>")).otherwise(F.lit(":response>")))
    uri = F.when(F.trim(F.coalesce("url", F.lit(""))) != "", F.regexp_replace("url", r"[\r\n]", ""))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    head = F.concat_ws(CRLF, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("bytes").cast("string")))
    common = [("WARC-Date", F.lit("2024-01-01T00:00:00Z")), ("WARC-Target-URI", uri)]
    http = "application/http; msgtype="
    response = _record(
        [("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", rid), *common,
         ("WARC-Payload-Digest", digest), ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
         ("WARC-Refers-To", F.when(revisit, F.concat(urn(F.col("owner"), F.lit(1)), F.lit(":response>")))),
         ("Content-Type", F.lit(http + "response"))],
        F.concat(head, F.lit(CRLF * 2), F.when(revisit, F.lit("")).otherwise(F.col("html"))),
    )
    host = F.coalesce(F.try_parse_url(uri, F.lit("HOST")), F.lit("none"))
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", F.concat(name, F.lit(":request>"))), *common, ("WARC-Concurrent-To", rid), ("Content-Type", F.lit(http + "request"))],
        F.concat(F.lit("GET / HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF * 2)),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", F.concat(name, F.lit(":metadata>"))), *common, ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)),
    )
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("compression", "gzip").option("lineSep", CRLF * 2).option("maxRecordsPerFile", 3 * file_rows).text(path)


def parse_record(data: bytes):
    """(headers with lower-case names, all concurrent ids, block) of one whole record, or
    the size that data must reach where it ends before the record does."""
    if data[:5] != b"WARC/":
        raise ValueError(f"no WARC record: {data[:40]!r}")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return len(data) + 1
    headers, concurrent = {}, []
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
        if name.strip().lower() == "warc-concurrent-to":
            concurrent.append(value.strip())
    stop = end + 4 + int(headers["content-length"])
    if len(data) < stop:
        return stop
    if data[stop:].strip(b"\r\n"):
        raise ValueError(f"a record is longer than it says: {data[:200]!r}")
    return headers, concurrent, data[end + 4 : stop]


def records_of(segments):
    """Records from the parts of archives between SEPARATORs, in their order: a separator
    inside a block leaves a record unfinished and is put back."""
    held: list[bytes] = []
    size = need = 0
    for part in segments:
        if held:
            held += [SEPARATOR, part]
            size += len(SEPARATOR) + len(part)
        else:
            part = part.lstrip(b"\r\n")
            if not part:
                continue
            held = [part if part[:5] == b"WARC/" else b"WARC/" + part]
            size, need = len(held[0]), 0
        if size >= need:
            held = [b"".join(held)]
            record = parse_record(held[0])
            if isinstance(record, int):
                need = record
            else:
                yield record
                held = []
    if held:
        raise ValueError(f"an archive ends within a record: {held[0][:200]!r}")


RECORDS = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
    "header_digest string, fields string, payload_bytes bigint, payload_sha256 string, block binary"
)
_KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
_NAMES = [c.split(" ")[0] for c in RECORDS.split(", ")]


def _row(h: dict, concurrent: list, block: bytes) -> tuple:
    size = digest = fields = None
    if h.get("warc-type") in ("response", "resource"):
        payload = block
        if h.get("content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    if h.get("content-type") == "application/warc-fields":
        fields = block.decode("utf-8", "replace")
    said = h.get("warc-payload-digest", "").rpartition(":")[2] or None
    return (h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), concurrent, h.get("warc-refers-to"), said, fields, size, digest, block)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives (gzip, of one member or many, or plain) under path.

    Spark's text reader streams the archives and cuts them before "WARC/"; a task holds one
    record at a time, whatever the size of a file. A compressed archive is one task's. A
    plain one may be split: a block that holds the separator across a split raises an error.
    """
    parts = spark.read.option("lineSep", SEPARATOR.decode()).text(path).select(F.col("value").cast("binary").alias("part"))

    def parse(batches):
        rows = []
        for record in records_of(x.as_py() for b in batches for x in b["part"]):
            rows.append(_row(*record))
            if len(rows) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)

    return parts.mapInArrow(parse, RECORDS)


def assemble(records: DataFrame, *, with_blocks: bool = True) -> DataFrame:
    """One nested row per capture: capture_id, response, requests, metadata.

    A response, resource or revisit record is a capture. Other records belong to the
    capture that they name in WARC-Concurrent-To or that names them, or to the capture of
    a record that they name. Records without any capture are not part of a row; a capture
    without request or metadata has empty lists; records that are named by several
    captures appear in each. with_blocks=False leaves the blocks where they are.
    """
    ids = records.select("record_id", "type", "concurrent_to").filter("record_id IS NOT NULL")
    anchor = F.col("type").isin("response", "resource", "revisit")
    captures = ids.filter(anchor).select(F.col("record_id").alias("to"), F.lit(True).alias("is_capture")).distinct()
    named = ids.select("record_id", anchor.alias("anchor"), F.explode("concurrent_to").alias("to"))
    forward = named.filter("NOT anchor").select(F.col("record_id").alias("member"), "to")
    backward = named.filter("anchor").select(F.col("to").alias("member"), F.col("record_id").alias("to"))
    links = forward.unionByName(backward).distinct().join(captures.hint("merge"), "to", "left")
    direct = links.filter("is_capture").select("member", F.col("to").alias("capture"))
    through = links.filter("is_capture IS NULL").select("member", F.col("to").alias("via")).join(
        direct.select(F.col("member").alias("via"), "capture").hint("merge"), "via"
    ).select("member", "capture")
    member_of = direct.unionByName(through).distinct()
    body = [c for c in records.columns if with_blocks or c != "block"]
    whole = F.struct(*body).alias("record")
    members = records.filter(~anchor).select(F.col("record_id").alias("member"), F.col("type").alias("kind"), whole).join(member_of.hint("merge"), "member")
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("record"))))
    grouped = members.groupBy("capture").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    empty = lambda c: F.coalesce(F.col(c), F.array())
    return (
        records.filter(anchor).select(F.col("record_id").alias("capture"), whole.alias("response"))
        .join(grouped.hint("merge"), "capture", "left")
        .select(F.col("capture").alias("capture_id"), "response", empty("requests").alias("requests"), empty("metadata").alias("metadata"))
    )


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Captures with the full payload's size and digest, and the page referred to."""
    page = F.regexp_extract(F.get(F.col("metadata.fields"), F.lit(0)), r"page_id: (-?\d+)", 1).try_cast("bigint")
    rows = captures.select(
        page.alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.record_id").alias("record_id"), F.col("response.refers_to").alias("to"),
        F.col("response.payload_bytes").alias("bytes"), F.col("response.payload_sha256").alias("sha256"), F.col("response.header_digest").alias("said"),
    )
    # what refers to nothing gets a key that no other has: nulls would all meet in one task
    rows = rows.withColumn("to", F.coalesce("to", F.concat(F.lit("none "), "record_id")))
    full = rows.filter("record_type = 'response'").select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("to_bytes"), F.col("sha256").alias("to_sha256"))
    return rows.join(full.hint("merge"), "to", "left").select(
        "page_id", F.coalesce("bytes", "to_bytes").alias("payload_bytes"), F.coalesce("sha256", "to_sha256", "said").alias("payload_digest"), "record_type", "refers_to"
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = staged(read_warc(spark, path), "records")
    return resolve_revisits(assemble(records, with_blocks=False))


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, min(page_id) AS owner FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN o.owner < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN o.owner < p.page_id THEN o.owner END AS refers_to
FROM p LEFT JOIN o USING (payload_digest)
"""
