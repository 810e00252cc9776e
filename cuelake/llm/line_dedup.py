"""Line dedup on levelled sorted runs of line hashes."""
from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm.common import WS_CHARS, drop_path, stage_path, staged, text_key

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case (lower() takes ASCII alone
    byte by byte, but would change other letters)."""
    bare = F.trim(line, F.lit(WS_CHARS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hash(key: Column) -> Column:
    """16 bytes: at 10^13 lines a 64-bit hash would collide, 128 bits do not."""
    return F.unhex(F.md5(key))


class LineRuns:
    """Levelled sorted runs of (h, owner): a line hash and the first document that had it.

    Every run is a table bucketed and sorted by h, in the shared folder. A batch adds one
    run to level 0; when a level holds `fanout` runs they are merged, bucket by bucket,
    into one run of the next level: a hash is rewritten once a level, and a batch meets
    at most fanout * levels runs. All runs have the same buckets, so the batch is
    exchanged once and merge-joins one run after another; no run is exchanged again.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def known(self) -> list[DataFrame]:
        """The runs, the largest first; a hash is in one run only."""
        return [self.spark.table(name) for level in reversed(self.levels) for name, _ in level]

    def admit(self, lines: DataFrame) -> DataFrame:
        """Owners (h, owner, latest) of every hash in `lines` (h, doc_id), after adding the
        new ones; latest is the largest doc_id of the batch that holds it.

        The batch's hashes are reduced to one row each before the exchange; those that no
        run holds become the batch's run.
        """
        rows = lines.groupBy("h").agg(F.min("doc_id").alias("mine"), F.max("doc_id").alias("latest"), F.lit(None).cast("bigint").alias("owner"))
        for run in self.known():
            run = run.select("h", F.col("owner").alias("found"))
            rows = rows.join(run.hint("merge"), "h", "left").select("h", "mine", "latest", F.coalesce("owner", "found").alias("owner"))
        batch = stage_path(self.spark, "line-owners")
        rows.select("h", F.coalesce("owner", "mine").alias("owner"), "latest", F.isnull("owner").alias("new")).write.parquet(batch)
        owners = self.spark.read.schema("h binary, owner bigint, latest bigint, new boolean").parquet(batch)
        self._write(owners.filter("new").select("h", "owner"), 0)
        return owners.select("h", "owner", "latest")

    def _write(self, rows: DataFrame, level: int) -> None:
        path = stage_path(self.spark, f"line-run-{level}")
        name = os.path.basename(path).replace("-", "_")
        rows.repartition(self.buckets, "h").write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(reduce(DataFrame.unionByName, [self.spark.table(name) for name, _ in old]), level + 1)
            self.drop(old)

    def drop(self, runs: list | None = None) -> None:
        """Delete runs (all of them unless given)."""
        for name, path in runs or [run for level in self.levels for run in level]:
            self.spark.sql(f"DROP TABLE {name}")
            drop_path(self.spark, path)


def dedup_lines(docs: DataFrame, *, min_chars: int = 10, batches: int = 4, fanout: int = 4, runs: LineRuns | None = None) -> DataFrame:
    """Drop lines that a document with a smaller doc_id also holds.

    A text is split at newlines (null or empty: one empty line). Lines are equal if
    their keys are: white space stripped at both ends, A-Z in lower case. A key of
    at least `min_chars` code points that several documents hold keeps its lines only
    in the smallest doc_id holding it, all of them; shorter lines always stay.

    Documents are taken in `batches` ranges of ascending doc_id with like numbers of
    rows, each against the runs of all before. Only hashes, ids and line numbers are
    exchanged before the dropped positions meet the texts in one join, and of the
    owners only those of lines that a later document holds.

    Columns of `docs` stay (text is the kept text), plus n_lines and n_dropped.
    Rows without doc_id pass whole and own nothing; rows that repeat a doc_id are
    judged as one document; an empty table gives an empty table; columns with other
    names are carried, n_lines and n_dropped of the input are replaced.
    """
    spark = docs.sparkSession
    own, runs = runs is None, runs or LineRuns(spark, fanout)
    docs = docs.drop("n_lines", "n_dropped")
    marks = [k / batches for k in range(1, batches)]
    high, *cuts = docs.agg(F.max("doc_id"), *[F.percentile_approx("doc_id", m, 1_000) for m in marks]).first()
    found = []
    if high is not None:
        ends = sorted({*cuts, high})
        for above, upto in zip([None, *ends], ends):
            part = docs.select("doc_id", "text").filter(F.col("doc_id") <= upto)
            part = part if above is None else part.filter(F.col("doc_id") > above)
            lines = (
                part.select("doc_id", text_key("text").alias("_row"), F.posexplode(F.split("text", "\n")).alias("_at", "_line"))
                .select("doc_id", "_row", "_at", line_key(F.col("_line")).alias("_key"))
                .filter(F.length("_key") >= min_chars)
                .select("doc_id", "_row", "_at", line_hash(F.col("_key")).alias("h"))
            )
            lines = staged(lines, "line-hashes", compression="none")  # hashed once for both joins
            owners = runs.admit(lines).filter("owner < latest").select("h", "owner")
            found.append(
                lines.join(owners.hint("merge"), "h").filter(F.col("owner") < F.col("doc_id")).select("doc_id", "_row", "_at")
            )
        if own:
            runs.drop()
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    if not found:
        return docs.withColumns({"n_lines": F.size(split).cast("long"), "n_dropped": F.lit(0).cast("long"), "text": F.coalesce("text", F.lit(""))})
    drops = reduce(DataFrame.unionByName, found).groupBy("doc_id", "_row").agg(F.collect_set("_at").alias("_drops"))
    kept_at = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drops"))
    return (
        docs.withColumns({"_row": text_key(F.col("text")), "_doc": F.col("doc_id")})
        .join(drops.withColumnRenamed("doc_id", "_doc").hint("merge"), ["_doc", "_row"], "left")
        .withColumn("_lines", split)
        .withColumns({
            "n_lines": F.size("_lines").cast("long"),
            "n_dropped": F.coalesce(F.size("_drops"), F.lit(0)).cast("long"),
            "text": F.when(F.col("_drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(
                F.array_join(F.transform(kept_at, lambda i: F.get(F.col("_lines"), i)), "\n")
            ),
        })
        .select(*docs.columns, "n_lines", "n_dropped")
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.doc_id, k.line, k.pos, coalesce(o.owner < k.doc_id, false) AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
