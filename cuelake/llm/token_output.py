"""Token ids in directly addressable codes.

File format. A table of segments, one row each, in Parquet (uncompressed; the codes are
dense already): first_doc, doc_ids array<bigint>, n_tokens array<bigint> and `codes`
binary. `codes` holds the ids of the segment's documents one after another:

    magic b"DAC1", uint32 number of ids n, uint32 number of levels L
    for each level l = 0 .. L-1 (n_0 = n; n_{l+1} = ids with a further chunk):
        uint32 n_l
        n_l bytes           chunk l: bits 8l .. 8l+7 of the id
        ceil(n_l/8) bytes   continuation bitmap, little bit order: a chunk l+1 follows
        uint32 per 512 bits rank directory: set bits before the block
    (the last level has no bitmap and no directory)

Id i is read by its byte in level 0 and, while its continuation bit is set, by the byte
at rank(i) in the next level: no block is decoded to reach it.
"""
from __future__ import annotations

import json
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuelake.llm.common import batch_words, slices, stage_path

END_ID = 2
#: Ids of a segment at which it is closed, after the document that reaches it.
SEGMENT = 1 << 20
#: Pieces whose ids a worker keeps before it starts afresh, and bytes of texts encoded together.
CACHE, BATCH_BYTES = 400_000, 8 << 20
BLOCK = 512
#: Pieces of a word as the tokenizer's own pattern cuts them, and characters outside the
#: range in which lower case, NFC and the classes of the pattern are taken from here.
LAST_PLAIN = 0x17F
PIECE = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
OTHER = r"[^\x00-\x{17F}]|\x{85}|\x{A0}|\x{130}"
LETTERS = "".join(c for c in map(chr, range(LAST_PLAIN + 1)) if c.isalpha())
MARKS = string.punctuation

_ENCODERS: dict = {}
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint32)


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable codes of an array of non-negative ids below 2**32."""
    rest = np.asarray(ids, np.uint32)
    levels = []
    while True:
        more = rest > 0xFF
        low = (rest & 0xFF).astype(np.uint8).tobytes()
        if not more.any():
            levels.append(np.uint32(len(rest)).tobytes() + low)
            break
        bits = np.packbits(more, bitorder="little")
        per = _POP[bits]
        blocks = np.add.reduceat(per, np.arange(0, len(per), BLOCK // 8))
        ranks = np.concatenate(([0], np.cumsum(blocks)[:-1])).astype(np.uint32)
        levels.append(np.uint32(len(rest)).tobytes() + low + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
    return b"DAC1" + np.array([len(ids), len(levels)], np.uint32).tobytes() + b"".join(levels)


class Codes:
    """Random access to packed ids."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a DAC1 segment")
        self.n, count = (int(x) for x in np.frombuffer(data, np.uint32, 2, 4))
        self.levels, at = [], 12
        for level in range(count):
            n = int(np.frombuffer(data, np.uint32, 1, at)[0])
            low = np.frombuffer(data, np.uint8, n, at + 4)
            at += 4 + n
            bits = ranks = None
            if level < count - 1:
                size = (n + 7) // 8
                bits = np.frombuffer(data, np.uint8, size, at)
                ranks = np.frombuffer(data, np.uint32, (n + BLOCK - 1) // BLOCK, at + size)
                at += size + 4 * len(ranks)
            self.levels.append((low, bits, ranks))

    def _rank(self, level: int, i: int) -> int:
        """Set continuation bits before position i."""
        low, bits, ranks = self.levels[level]
        if i >= len(low):
            return len(self.levels[level + 1][0])
        block = i // BLOCK
        n = int(ranks[block]) + int(_POP[bits[block * BLOCK // 8 : i // 8]].sum())
        return n + int(_POP[bits[i // 8] & ((1 << (i % 8)) - 1)])

    def __getitem__(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids start .. end-1: one directory look-up a level for the whole range."""
        out = np.zeros(end - start, np.uint32)
        into = np.arange(end - start)
        for level, (low, bits, _) in enumerate(self.levels):
            if start >= end:
                break
            out[into] |= low[start:end].astype(np.uint32) << np.uint32(8 * level)
            if bits is None:
                break
            first = start // 8
            more = np.unpackbits(bits[first : (end + 7) // 8], bitorder="little")[start - 8 * first : end - 8 * first].astype(bool)
            into = into[more]
            start = self._rank(level, start)
            end = start + len(into)
        return out


class WordEncoder:
    """The library's tokenizer, with the ids of the pieces met so far; kept by the worker.

    The tokenizer normalises a text, cuts it into pieces that hold no white space and merges
    inside a piece only, so a piece has the same ids wherever it stands. Words of plain
    letters, digits and marks are cut here as the tokenizer cuts them (see PIECE) and their
    new pieces given to its model many to a call; words with other characters or with a
    special token's string go whole through the unchanged tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        parts = json.loads(self.whole.to_str())
        special = "|".join(re.escape(t["content"]) for t in parts["added_tokens"])
        self.other = OTHER + (f"|{special}" if special else "")
        vocab = parts["model"]["vocab"]
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a piece
        self.last[[i for t, i in vocab.items() if t.endswith(parts["model"]["end_of_word_suffix"])]] = True
        parts |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(parts))
        byte = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        byte |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in byte)}
        self.bytes = {c: "".join(byte[b] for b in chr(c).encode()) for c in range(LAST_PLAIN + 1) if c != 32}
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.ids, self.size = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]

    def learn(self, pieces: list[str]) -> None:
        """Ids of new pieces, those with other characters after the rest."""
        other = pc.match_substring_regex(pa.array(pieces, pa.string()), self.other).to_pylist()
        plain = [p for p, o in zip(pieces, other) if not o]
        rest = [p for p, o in zip(pieces, other) if o]
        texts = [" ".join(plain[k : k + 2_000]).translate(self.bytes) for k in range(0, len(plain), 2_000)]
        for e in self.model.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, np.uint32)
            self.ids.append(ids)
            self.size.append(np.diff(np.flatnonzero(self.last[ids]), prepend=-1))
        for e in self.whole.encode_batch_fast(rest, add_special_tokens=False):
            self.ids.append(np.array(e.ids, np.uint32))
            self.size.append(np.array([len(e.ids)], np.int64))
        self.at.update(zip(plain + rest, range(len(self.at), len(self.at) + len(pieces))))
        self.ids, self.size = [np.concatenate(self.ids)], [np.concatenate(self.size)]
        if len(self.size[0]) != len(self.at):
            raise ValueError("the ids do not tell the pieces apart")

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the pieces of all words in order, number of pieces of each word)."""
        other = pc.match_substring_regex(words, self.other)
        low = pc.utf8_lower(words)
        # most words are letters, or letters and marks: only the rest needs the pattern
        mixed = pc.invert(pc.utf8_is_alpha(low))
        some = low.filter(mixed)
        base = pc.utf8_rtrim(some, MARKS)
        hard = pc.invert(pc.utf8_is_alpha(base))
        two = pc.binary_join_element_wise(base, pc.utf8_ltrim(some, LETTERS), pa.scalar(" ", low.type))
        two = pc.replace_with_mask(two, hard, pc.replace_substring_regex(some.filter(hard), PIECE, r"\1 "))
        cut = pc.replace_with_mask(low, mixed, two)
        split = pc.ascii_split_whitespace(pc.if_else(other, words, cut))
        flat = split.flatten().dictionary_encode()
        names = flat.dictionary.to_pylist()
        if len(self.at) > CACHE:
            self.forget()
        new = [p for p in names if p not in self.at]
        if new:
            self.learn(new)
        numbers = np.fromiter(map(self.at.__getitem__, names), np.int32, len(names))
        return numbers[flat.indices.to_numpy()], np.diff(split.offsets.to_numpy())


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions first, first + 1, .. of runs of the given sizes, one run after another."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0, dtype=first.dtype)


def encode_batch(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in order, number of ids of each), without end ids.

    Every distinct run between characters of [\\x20\\x09-\\x0D] is encoded once and its ids are
    gathered for each occurrence.
    """
    encoder = _encoder(path)
    codes, dictionary, starts = batch_words(texts)
    if not len(codes):
        return np.empty(0, np.uint32), np.zeros(len(starts) - 1, np.int64)
    numbers, held = encoder.pieces(dictionary)
    store, size = encoder.ids[0], encoder.size[0]
    first = np.cumsum(size) - size
    table = store[spread(first[numbers], size[numbers])]  # ids of the distinct words
    ends = np.concatenate(([0], np.cumsum(size[numbers])))[np.concatenate(([0], np.cumsum(held)))]
    each, begin = np.diff(ends).astype(np.int32), ends[:-1].astype(np.int32)
    ids = table[spread(begin[codes], each[codes])]
    total = np.concatenate(([0], np.cumsum(each[codes], dtype=np.int64)))
    return ids, total[starts[1:]] - total[starts[:-1]]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, *, segment: int = SEGMENT, end_id: int = END_ID) -> None:
    """Encode texts (null: empty), append end_id, write segments in ascending doc_id order.

    Documents are range-partitioned and sorted by doc_id, so segments follow one another
    by first_doc; a partition is streamed, one open segment at a time.
    Rows without doc_id are not addressable and are left out; rows that repeat a doc_id
    follow one another in the order of their texts. Other columns are not read.
    """
    ordered = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )

    def encode(batches):
        part = TaskContext.get().partitionId()
        no, keys, sizes, held, open_ids = 0, [], [], 0, []

        def close():
            return pa.RecordBatch.from_pydict(
                {"part": [part], "no": [no], "first_doc": [keys[0]], "doc_ids": [keys], "n_tokens": [sizes], "codes": [pack(np.concatenate(open_ids))]},
                schema=pa.schema([("part", pa.int32()), ("no", pa.int32()), ("first_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("codes", pa.binary())]),
            )

        for b in batches:
            for some in slices(b, "text", BATCH_BYTES):
                ids, counts = encode_batch(some["text"], tokenizer)
                where = 0
                for doc, n in zip(some["doc_id"].to_pylist(), counts.tolist()):
                    open_ids += [ids[where : where + n], np.array([end_id], np.uint32)]
                    where += n
                    keys.append(doc)
                    sizes.append(n + 1)
                    held += n + 1
                    if held >= segment:
                        yield close()
                        no, keys, sizes, held, open_ids = no + 1, [], [], 0, []
        if keys:
            yield close()

    schema = "part int, no int, first_doc bigint, doc_ids array<bigint>, n_tokens array<bigint>, codes binary"
    ordered.mapInArrow(encode, schema).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before: offsets of the parts (one row a
    part, at most the number of partitions written) and then within each part.
    """
    segments = spark.read.parquet(path)
    total = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = segments.select("part", "no", "first_doc", total.alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"), F.min("first_doc").alias("first_doc"))
    offsets = parts.select(F.col("part"), F.coalesce(F.sum("n").over(W.orderBy("first_doc", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = sizes.select("part", "no", F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("inner"))
    starts = inner.join(F.broadcast(offsets), "part").select("part", "no", (F.col("base") + F.col("inner")).alias("base"))

    def decode(batches):
        for b in batches:
            for part, no, docs, sizes, data in zip(*(b[c].to_pylist() for c in ("part", "no", "doc_ids", "n_tokens")), b["codes"]):
                codes = Codes(data.as_py())
                ends = np.cumsum(np.array(sizes, np.int64))
                begin = ends - np.array(sizes, np.int64)
                crc = [zlib.crc32(codes.slice(int(s), int(e)).astype("<u4").tobytes()) for s, e in zip(begin, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(docs), pa.int32()), pa.array([no] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(begin), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "no", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    read = segments.select("part", "no", "doc_ids", "n_tokens", "codes").mapInArrow(decode, "part int, no int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(starts.hint("merge"), ["part", "no"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = stage_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_tokens(spark, path)
