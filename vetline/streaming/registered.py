"""A registry that holds each key once, in buckets by the hash of the key.

A batch reads the keys of the buckets it falls into, nothing else of the registry, and appends what is new as
files of its own. A null key is a key like any other: it is registered once. The first row in order wins within a batch, and what
is stored wins over what comes later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vetline.operators.joins import append_once
from vetline.session import stored
from vetline.sources.folders import Folder
from vetline.streaming.tables import Commits, bucket_of, no_rows, stream_of, with_columns

BUCKETS = 64


class Registry:
    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets
        self.folder, self.done = Folder(spark, f"{path}/rows"), Commits(spark, path)

    def _read(self, buckets: list[int] | None = None, last: int | None = None) -> DataFrame:
        last = self.done.last() if last is None else last
        if not self.folder.match("/bucket=*"):
            return no_rows(self.spark, with_columns(self.schema, bucket="integer"))
        rows = self.spark.read.schema(with_columns(self.schema, bucket="integer", v="long")).parquet(self.folder.path)
        rows = rows.filter(F.col("v") <= last)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def read(self) -> DataFrame:
        """What is registered; files of a batch that failed do not count."""
        return self._read().select(*self.schema.names)

    def register(self, batch: DataFrame, number: int, order: list[str]) -> None:
        """Register the keys of one batch that are new; the same batch twice counts once."""
        stream, last = stream_of(batch), self.done.last()
        version = self.done.next(stream, number)
        if version is None:
            return
        for path in self.folder.match(f"/bucket=*/v={version}"):
            self.folder.delete(f"/{path}")
        new = stored(batch.select(*self.schema.names, bucket_of(self.key, self.buckets).alias("bucket")), "batch")
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
        if touched:
            known = self._read(touched, last).select(self.key)
            append_once(known, new, self.key, order).withColumn("v", F.lit(version).cast("long")).repartition("bucket").write.mode(
                "append").partitionBy("bucket", "v").parquet(self.folder.path)
        self.done.add(version, stream, number)
