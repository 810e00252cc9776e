"""Keyed tables that change in place: a change rewrites the hash buckets that it touches, and no others."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.operators.shared import written

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """Rows by unique keys in `path`, a folder a hash bucket.

    Buckets are as many as the table was made with: some 100 MB each is right, so that a change reads
    and writes little besides its own keys. One writer at a time. A change that fails or is run
    again leaves each bucket as it was or as it shall be; run again, it gives the same table.
    """

    path: str
    keys: tuple[str, ...]
    buckets: int
    schema: str

    @classmethod
    def create(cls, rows: DataFrame, path: str, *keys: str, buckets: int = 16) -> KeyedTable:
        """A table of rows, which may be none; of rows with one key one stays, the largest."""
        table = cls(path, keys, buckets, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, *[c for c in rows.columns if c not in keys]).schema))
        table._put(table._one_each(rows), "errorifexists")
        return table

    def read(self, spark: SparkSession) -> DataFrame:
        return self._read(spark).drop(BUCKET)

    def upsert(self, rows: DataFrame, *, overwrite: bool = True) -> None:
        """Rows over those with their keys, or only beside them; rows without a key are left out."""

        def change(old: DataFrame, new: DataFrame) -> DataFrame:
            if overwrite:
                return self._anti(old, new).unionByName(new)
            return old.unionByName(self._anti(new, old))

        self.change(rows, change)

    def delete(self, rows: DataFrame) -> None:
        """Rows with these keys go."""
        self.change(rows.select(*self.keys), self._anti)

    def change(self, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Touched buckets become change(their rows, the new rows), both with the column of the bucket."""
        spark = rows.sparkSession
        new = written(self._one_each(rows).withColumn(BUCKET, self._bucket()), "changes")
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]
        if not touched:
            return
        merged = change(self._read(spark).filter(F.col(BUCKET).isin(touched)), new)
        left = {r[0] for r in merged.select(BUCKET).distinct().collect()}
        if left:
            self._put(merged, "overwrite")
        for bucket in set(touched) - left:  # a bucket without rows has nothing to be written over it
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={bucket}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    def follow(self, stream: DataFrame, checkpoint: str) -> None:
        """Takes what a stream in update mode changes, batch by batch, until its input is taken: the table holds the
        latest row of each key, and a batch writes the buckets of its keys only. A batch that is run again changes nothing."""
        sink = stream.writeStream.outputMode("update").foreachBatch(lambda rows, _: self.upsert(rows))
        sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _one_each(self, rows: DataFrame) -> DataFrame:
        held = rows.dropna(subset=list(self.keys))
        others = [c for c in rows.columns if c not in self.keys]
        if not others:
            return held.distinct()
        return held.groupBy(*self.keys).agg(F.max(F.struct(*others)).alias("_row")).select(*self.keys, "_row.*")

    def _anti(self, rows: DataFrame, other: DataFrame) -> DataFrame:
        return rows.join(other.select(*self.keys).hint("merge"), list(self.keys), "left_anti").select(rows.columns)

    def _read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)

    def _put(self, rows: DataFrame, mode: str) -> None:
        rows = rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET)
        rows.write.partitionBy(BUCKET).mode(mode).option("partitionOverwriteMode", "dynamic").parquet(self.path)
