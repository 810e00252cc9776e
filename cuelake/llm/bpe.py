"""Byte-level BPE over long texts in overlapping chunks."""
from __future__ import annotations

import base64
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.llm.common import text_key

#: Characters of a chunk, and of what it shares with the next.
CHUNK, OVERLAP = 32_768, 256
#: A match is certain if a contraction or one more character could not change it.
LOOKAHEAD = 4
#: Characters of one match beyond which it is encoded by itself: the library's pattern
#: runs out of stack on white space of some hundred thousand.
RUN = 20_000

_CODECS: dict = {}


class Codec:
    """Encoder and tables of one rank file; kept by the Python worker."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        top = max(ranks.values()) + 1
        self.raw, self.decimal = [b""] * top, [str(i) for i in range(top)]
        for token, rank in ranks.items():
            self.raw[rank] = token

    def encode(self, text: str) -> list[int]:
        if len(text) > RUN:
            matches = self.pattern.findall(text)
            if max(map(len, matches)) > RUN:
                return [i for m in matches for i in self.encoding._encode_single_piece(m)]
        return self.encoding.encode_ordinary(text)

    def decode(self, ids: list[int]) -> tuple[str, bytes]:
        """(ids in decimal, joined by commas; bytes of the tokens)."""
        return ",".join([self.decimal[i] for i in ids]), b"".join([self.raw[i] for i in ids])


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def safe_ends(text: str, pattern, last: bool) -> list[int]:
    """Ends of certain pre-tokens of a chunk that end in a visible character.

    A cut there leaves both sides' pre-tokens as they are: the only look-ahead of the
    pattern concerns white space before a cut.
    """
    limit = len(text) if last else len(text) - LOOKAHEAD
    return [e for m in pattern.finditer(text) if (e := m.end()) <= limit and not text[e - 1].isspace()]


def long_pieces(docs: DataFrame, path: str, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Cut long texts (doc_id, _row, copies, text) at pre-token boundaries: a row for each piece.

    1. Each text becomes chunks of `chunk` characters that run `overlap` characters into
       the next one; chunks are pre-tokenised in parallel, each from its own start.
    2. The scan has no memory, so once a boundary of a chunk is also one of the chunk
       before, all later ones agree. Chunks are stitched at the first common boundary
       in the overlap, where the chunk before is itself stitched.
    3. Else at the first boundary before white space: no pre-token holds white space after
       a visible character, so every scan has it. A chunk without one (within a run that
       is longer than a chunk) goes to the piece before it.
    """
    chunks = (
        docs.withColumn("_n", F.length("text"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / chunk).cast("int"))))
        .select("doc_id", "_row", "copies", "chunk", ((F.col("chunk") + 1) * chunk >= F.col("_n")).alias("last"),
                F.substr("text", F.col("chunk") * chunk + 1, F.lit(chunk + overlap)).alias("text"))
        .repartition("doc_id", "_row", "chunk")
    )

    def boundaries(batches):
        pattern = codec(path).pattern
        for b in batches:
            head, tail, sure, own = [], [], [], []
            for text, no, last in zip(b["text"].to_pylist(), b["chunk"].to_pylist(), b["last"].to_pylist()):
                ends = safe_ends(text, pattern, last)
                head.append([e for e in ends if e < min(overlap, chunk)] if no else [])
                tail.append([] if last else [e - chunk for e in ends if e > chunk])
                sure.append(next((e for e in ends if e < min(chunk, len(text)) and text[e].isspace()), None) if no else 0)
                own.append(text[:chunk])
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["_row"], b["copies"], b["chunk"], pa.array(own, pa.string()), pa.array(head, lists), pa.array(tail, lists), pa.array(sure, pa.int32())], names=["doc_id", "_row", "copies", "chunk", "text", "head", "tail", "sure"])

    schema = "doc_id bigint, _row bigint, copies bigint, chunk int, text string, head array<int>, tail array<int>, sure int"
    order = W.partitionBy("doc_id", "_row").orderBy("chunk")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    common = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    # stitched to a chunk with a sure boundary by common ones all the way
    known = F.max(F.when(F.col("sure").isNotNull(), F.col("chunk"))).over(so_far) >= F.coalesce(F.max(F.when(F.col("common").isNull(), F.col("chunk"))).over(so_far), F.lit(0))
    cut = (
        chunks.mapInArrow(boundaries, schema)
        .withColumn("common", common)
        .withColumn("known", known)
        .withColumn("cut", F.when(F.lag("known").over(order) & F.col("common").isNotNull(), F.col("common")).otherwise(F.col("sure")))
        .withColumn("piece", F.count("cut").over(so_far))
    )
    # up to its cut a chunk belongs to the piece before
    part = lambda piece, text: F.struct(piece.alias("piece"), text.alias("text"))
    parts = F.when(F.col("cut").isNull(), F.array(part(F.col("piece"), F.col("text")))).otherwise(F.array(
        part(F.col("piece") - 1, F.substr("text", F.lit(1), F.col("cut"))), part(F.col("piece"), F.substr("text", F.col("cut") + 1))))
    return (
        cut.select("doc_id", "_row", "copies", "chunk", F.explode(parts).alias("p")).filter("p.text <> ''")
        .groupBy("doc_id", "_row", "copies", "p.piece")
        .agg(F.array_sort(F.collect_list(F.struct("chunk", "p.text"))).alias("t"))
        .select("doc_id", "_row", "copies", "piece", F.array_join(F.col("t.text"), "").alias("text"))
    )


def encode_decode(docs: DataFrame, path: str, *, chunk: int = CHUNK, overlap: int = OVERLAP, with_ids: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Encode every text and decode its ids again: doc_id, n_tokens, ids_csv, decoded.

    ids_csv holds the ids in decimal, joined by commas; decoded the concatenated bytes
    of the tokens; with_ids adds ids array<int>. Null and empty texts have no tokens.
    A text of one chunk is encoded where it is read; longer ones are cut (see
    long_pieces), their pieces encoded in parallel and their ids joined in order before
    they are decoded. A match of more than RUN characters is encoded by itself. Rows that
    repeat a doc_id are kept apart by their text; equal rows give equal rows (long ones
    are encoded once and repeated). A null doc_id is carried. Other columns are dropped,
    but those named in carry stay with their row.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *carry).withColumns({"_row": text_key(F.col("text")), "_n": F.length("text")})
    out_names, out_kinds = ["n_tokens", "ids_csv", "decoded"], [pa.int64(), pa.string(), pa.binary()]

    def with_columns(b, drop, names, columns):
        held = [x for x in b.schema.names if x != drop]
        return pa.RecordBatch.from_arrays([*(b[x] for x in held), *columns], names=[*held, *names])

    def encode_texts(batches):
        c = codec(path)
        for b in batches:
            made = [(len(ids), *c.decode(ids)) for ids in map(c.encode, b["text"].to_pylist())]
            yield with_columns(b, "text", out_names, [pa.array([m[k] for m in made], kind) for k, kind in enumerate(out_kinds)])

    def encode_pieces(batches):
        c = codec(path)
        for b in batches:
            yield with_columns(b, "text", ["ids"], [pa.array([array("I", c.encode(t)).tobytes() for t in b["text"].to_pylist()], pa.binary())])

    def decode_texts(batches):
        c = codec(path)
        for b in batches:
            made = [(len(ids), *c.decode(ids)) for ids in (array("I", b"".join(x)).tolist() for x in b["ids"].to_pylist())]
            yield with_columns(b, "ids", out_names, [pa.array([m[k] for m in made], kind) for k, kind in enumerate(out_kinds)])

    held = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    made = "n_tokens bigint, ids_csv string, decoded binary"
    short = rows.filter(F.col("_n") <= chunk).select("doc_id", "text", *carry).mapInArrow(encode_texts, f"doc_id bigint{held}, {made}")
    long_rows = rows.filter(F.col("_n") > chunk).groupBy("doc_id", "_row").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    with_rows = rows.filter(F.col("_n") > chunk).select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), *carry)
    joined = (
        long_pieces(long_rows, path, chunk=chunk, overlap=overlap)
        .mapInArrow(encode_pieces, "doc_id bigint, _row bigint, copies bigint, piece bigint, ids binary")
        .groupBy("doc_id", "_row", "copies").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
        .select("doc_id", "_row", "copies", F.col("p.ids").alias("ids"))
        .mapInArrow(decode_texts, f"doc_id bigint, _row bigint, copies bigint, {made}")
    )
    if carry:
        joined = joined.join(with_rows.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")))
    else:
        joined = joined.withColumn("_c", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    columns = ["doc_id", *carry, "n_tokens", "ids_csv", "decoded"]
    out = short.select(columns).unionByName(joined.select(columns))
    if with_ids:
        out = out.withColumn("ids", F.when(F.col("ids_csv") == "", F.array().cast("array<int>")).otherwise(F.split("ids_csv", ",").cast("array<int>")))
    return out


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids_csv", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
