"""Exact removal of repeated word windows by super-k-mers."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelake.llm.common import batch_words, mix64, shingle_hashes, slices, string_hashes, text_key

#: Words of a window and of the grams whose smallest hash is a window's minimiser.
WINDOW, GRAM = 20, 4
#: Bytes of a batch packed together, and of a bucket aimed at.
BATCH_CHARS, BUCKET_CHARS = 16 << 20, 24 << 20


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def super_kmers(hashes: np.ndarray, starts: np.ndarray, window: int, gram: int):
    """(first window, one past the last, minimiser) of every super-k-mer of the texts.

    A super-k-mer is a longest run of consecutive windows of one text with one minimiser.
    hashes: words of all texts; starts: first word of each text, and the end.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    low = sliding_min(shingle_hashes(hashes, gram), window - gram + 1)
    inside = np.zeros(n + 1, np.int8)
    a, b = starts[:-1], np.maximum(starts[1:] - window + 1, starts[:-1])
    np.add.at(inside, np.minimum(a, n), 1)
    np.add.at(inside, np.minimum(b, n), -1)
    full = np.cumsum(inside[:-1]) > 0
    new = np.ones(n, bool)
    new[1:] = (low[1:] != low[:-1]) | ~full[:-1]
    firsts = np.zeros(n, bool)
    firsts[a[a < n]] = True
    begin = np.flatnonzero((new | firsts) & full)
    stop = np.flatnonzero(~full)
    nxt = np.append(begin[1:], n)
    if len(stop):
        k = np.searchsorted(stop, begin)
        nxt = np.minimum(nxt, np.where(k < len(stop), stop[np.minimum(k, len(stop) - 1)], n))
    return begin, nxt, low[begin]


def _pack(docs, rows, firsts, counts, text: str) -> bytes:
    head = np.array([len(docs)], np.int64).tobytes() + b"".join(np.ascontiguousarray(x, np.int64).tobytes() for x in (docs, rows, firsts, counts))
    return zstandard.ZstdCompressor(level=3).compress(head + text.encode("utf-8", "surrogatepass"))


def _unpack(data: bytes):
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 4 * n, 8).reshape(4, n)
    return head, data[8 + 32 * n :]


def packed(docs: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """(bucket, data): the super-k-mers of a batch of texts for each bucket.

    A super-k-mer travels as its words joined by one space, a line each, with doc_id,
    row tag, first word and number of windows. A batch sends one copy of each super-k-mer,
    that of the smallest (doc_id, row, first word): windows of other copies are repeats
    already, and travel as ranges without words (count < 0). Those need no other window, so
    they go to buckets of their own, from `buckets` on, spread by document: a passage found
    everywhere does not send them all to one task.
    """

    # few enough that a batch does not send a row for each document
    spread_over = max(1, buckets // 16)

    def rows(batches):
        for b in batches:
            for some in slices(b, "text", BATCH_CHARS):
                yield from one(some)

    def one(b):
        ids, tags = b["doc_id"].to_numpy(), b["_row"].to_numpy()
        codes, dictionary, starts = batch_words(b["text"])
        if not len(codes):
            return
        begin, end, low = super_kmers(string_hashes(dictionary)[codes], starts, window, gram)
        if not len(begin):
            return
        doc = np.searchsorted(starts, begin, "right") - 1
        word = dictionary.to_numpy(zero_copy_only=False)
        text = word[codes]
        bucket = (mix64(low) % np.uint64(buckets)).astype(np.int64)
        spread = buckets + (mix64(ids.astype(np.uint64)) % np.uint64(spread_over)).astype(np.int64)
        order = np.lexsort((begin - starts[doc], tags[doc], ids[doc]))
        groups: dict = {}
        seen: dict = {}
        for i in order.tolist():
            s, e, d = int(begin[i]), int(end[i]), int(doc[i])
            line = " ".join(text[s : e + window - 1])
            at = (int(ids[d]), int(tags[d]), s - int(starts[d]))
            old = seen.setdefault(line, at)
            if old is not at and old == at:
                continue
            g = groups.setdefault(int(bucket[i] if old is at else spread[d]), ([], [], [], [], []))
            g[0].append(at[0])
            g[1].append(at[1])
            g[2].append(at[2])
            if old is at:
                g[3].append(e - s)
                g[4].append(line)
            else:
                g[3].append(s - e)
        names = list(groups)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array([_pack(*groups[k][:4], "\n".join(groups[k][4])) for k in names], pa.binary())], names=["bucket", "data"]
        )

    return docs.mapInArrow(rows, "bucket bigint, data binary")


def bucket_repeats(parts: list[bytes], window: int):
    """(doc_id, row, first word, windows) of every run of windows seen earlier.

    Windows are sorted by hash; those with one hash are compared word by word with the
    first of them, so equal hashes of unequal windows are told apart.
    """
    heads, bodies = zip(*map(_unpack, parts))
    head = np.concatenate(heads, axis=1)
    known = head[:, head[3] < 0]
    out = [np.stack((known[0], known[1], known[2], -known[3]))]
    head = head[:, head[3] > 0]
    lines = pa.array([x for t in bodies if t for x in t.split(b"\n")], pa.binary()).cast(pa.string())
    if not len(lines):
        return np.concatenate(out, axis=1)
    codes, dictionary, starts = batch_words(lines)
    h = shingle_hashes(string_hashes(dictionary)[codes], window)
    count = head[3]
    ends = np.cumsum(count)
    line = np.repeat(np.arange(len(count), dtype=np.int32), count)
    offset = np.arange(ends[-1]) - np.repeat(ends - count, count)
    at = starts[line] + offset
    key = h[at]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    some = order[twice]
    del h, order, same, twice
    # looked up for windows that meet an equal hash, which are few
    doc, row, pos = (lambda i: head[0][line[i]]), (lambda i: head[1][line[i]]), (lambda i: head[2][line[i]] + offset[i])
    if len(some):
        some = some[np.lexsort((pos(some), row(some), doc(some), key[some]))]
        while len(some):
            k = key[some]
            first = np.ones(len(some), bool)
            first[1:] = k[1:] != k[:-1]
            lead = some[np.maximum.accumulate(np.where(first, np.arange(len(some)), 0))]
            span = np.arange(window)
            equal = np.concatenate([(codes[at[some[i : i + 200_000], None] + span] == codes[at[lead[i : i + 200_000], None] + span]).all(axis=1) for i in range(0, len(some), 200_000)])
            later = equal & ~((doc(some) == doc(lead)) & (row(some) == row(lead)) & (pos(some) == pos(lead)))
            hit = np.sort(some[later])
            if len(hit):
                brk = np.ones(len(hit), bool)
                brk[1:] = (hit[1:] != hit[:-1] + 1) | (line[hit[1:]] != line[hit[:-1]])
                b = np.flatnonzero(brk)
                out.append(np.stack((doc(hit[b]), row(hit[b]), pos(hit[b]), np.diff(np.append(b, len(hit))))))
            some = some[~equal]
    return np.concatenate(out, axis=1)


def dedup_substrings(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None) -> DataFrame:
    """Remove every word covered by a window of words that also starts earlier.

    Words are runs outside [\\x20\\x09-\\x0D], unchanged; a window is `window` consecutive words
    of one document; earlier means a smaller doc_id, or the same document and an earlier
    start. Windows are judged on the input.

    Consecutive windows with one minimiser (the smallest hash of their `gram`-word grams)
    travel together to the minimiser's bucket, where equal windows must meet. Buckets are
    sized by the corpus; each batch sends one copy of a repeated super-k-mer, so that a
    passage found everywhere costs its bucket one copy a batch; its other copies are known
    repeats and stay out of that bucket. The ranges found are joined to the texts once.

    Columns of docs stay (text: kept words joined by one space), plus n_words and n_removed.
    Null or blank texts become empty. Rows that repeat doc_id and text are one document
    and get the same result; other rows with one doc_id follow in a fixed order. Rows without
    doc_id take no part and lose no word. An empty table gives an empty table.
    """
    docs = docs.drop("n_words", "n_removed")
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("_row"), "text")
    if buckets is None:
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        buckets = max(64, -(-3 * chars // BUCKET_CHARS))

    def repeats(table: pa.Table) -> pa.Table:
        found = bucket_repeats(table["data"].to_pylist(), window)
        return pa.Table.from_arrays([pa.array(found[i]) for i in range(4)], names=["doc_id", "_row", "first", "windows"])

    ranges = (
        packed(keyed.filter("doc_id IS NOT NULL AND text IS NOT NULL"), buckets, window, gram)
        .groupBy("bucket").applyInArrow(repeats, "doc_id bigint, _row bigint, first bigint, windows bigint")
        .groupBy("doc_id", "_row").agg(F.collect_list("first").alias("_first"), F.collect_list("windows").alias("_windows"))
    )
    joined = (
        docs.withColumns({"_row": text_key(F.col("text")), "_doc": F.col("doc_id")})
        .join(ranges.withColumnRenamed("doc_id", "_doc").hint("merge"), ["_doc", "_row"], "left")
        .select(*docs.columns, "_first", "_windows")
    )
    schema = joined.drop("_first", "_windows").schema.add("n_words", T.LongType()).add("n_removed", T.LongType())
    names = schema.names
    run = r"[^\x20\x09-\x0D]+"

    def cut(batches):
        import re

        find = re.compile(run).findall
        for b in batches:
            kept, n, gone = [], [], []
            for text, first, windows in zip(b["text"], b["_first"], b["_windows"]):
                w = find(text.as_py() or "")
                n.append(len(w))
                first, windows = first.as_py(), windows.as_py()
                if first:
                    edge = np.zeros(len(w) + 1, np.int32)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, np.array(first) + np.array(windows) + window - 1, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    w = [x for x, s in zip(w, stay.tolist()) if s]
                gone.append(n[-1] - len(w))
                kept.append(" ".join(w))
            made = {"text": pa.array(kept, pa.string()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else b[c] for c in names], names=names)

    return joined.mapInArrow(cut, schema)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))

