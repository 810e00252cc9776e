"""Helpers shared by the training-data operators."""
from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One white-space character of the contracts, as a Java/RE2/Python character class.
WS = r"[\x20\x09-\x0D]"
#: The same characters as a literal string, for trim().
WS_CHARS = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a local session (tests) gets a temporary folder of
    this machine, set once; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="cuelake-", dir=os.environ.get("TMPDIR"))
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cuelake/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str = "zstd", parts: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends
    there, so a lost executor costs a re-read and not a recomputation.

    parts: files to write at most, for tables of few and short rows; it should follow
    the number of rows."""
    path = stage_path(df.sparkSession, name)
    if parts:
        df = df.coalesce(parts)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def words(text: Column) -> Column:
    """Array of the maximal runs of characters outside WS; null or blank: empty."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS + "+"))


def text_key(*columns: Column) -> Column:
    """64-bit tag that tells rows with one id but other texts apart."""
    return F.xxhash64(*columns)


def batch_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of a batch of texts (null: none) as dictionary codes.

    Returns (codes of all words in order, the dictionary, first word of each text
    with one more entry at the end).
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(texts)
    flat, offsets = split.flatten(), split.offsets.to_numpy()
    offsets = offsets - offsets[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    if not full.all():
        codes = codes[full]
        kept = np.concatenate(([0], np.cumsum(full)))
        offsets = kept[offsets]
    return codes.astype(np.int64), encoded.dictionary, offsets.astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, size: int):
    """Parts of a batch with some `size` bytes of a string column each; longer rows stand alone."""
    held = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)) // size
    cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), batch.num_rows]
    return (batch.slice(s, e - s) for s, e in zip(cuts, cuts[1:]) if e > s)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def string_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct strings, the same in every batch and task."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(v) for v in values.to_pylist()), dtype=np.uint64, count=len(values))


def shingle_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes; position i covers i .. i+n-1."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + word_hashes[k : k + m] + np.uint64(k + 1))
    return h
