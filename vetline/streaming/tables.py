"""Tables that a stream keeps up to date: folders of (slice of positions, bucket of keys), replaced whole.

A batch writes new versions of the folders it touches, then one marker that makes them current, and then deletes
the versions before. A batch that fails leaves no trace in what is read, a batch that runs again does nothing
or the same. Every cell of a table is at ``<name>/slice=<s>/bucket=<b>/v=<version>``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vetline.sources.folders import Folder

Cell = tuple[int, int]


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of a key; null keys share one."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def with_columns(schema: StructType, **types: str) -> StructType:
    out = StructType([*schema.fields])
    for name, kind in types.items():
        out.add(name, kind)
    return out


def no_rows(spark: SparkSession, schema: StructType) -> DataFrame:
    """An empty table that the optimizer knows to be empty, so that joins and unions with it go."""
    return spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]).filter(F.lit(False))


def _values(path: str) -> list[int]:
    return [int(part.partition("=")[2]) for part in path.split("/")]


@dataclass
class CellTable:
    """One table of cells; ``schema`` is that of its rows."""
    spark: SparkSession
    base: str
    name: str
    schema: StructType

    def __post_init__(self) -> None:
        self.folder = Folder(self.spark, f"{self.base}/{self.name}")

    def versions(self, slices: Iterable[int] | None = None) -> dict[Cell, list[int]]:
        """The versions of each cell, of some slices or all."""
        found: dict[Cell, list[int]] = {}
        for s in ["*"] if slices is None else slices:
            for path in self.folder.match(f"/slice={s}/bucket=*/v=*"):
                a, b, v = _values(path)
                found.setdefault((a, b), []).append(v)
        return found

    def slices(self) -> list[int]:
        return sorted(_values(p)[0] for p in self.folder.match("/slice=*"))

    def current(self, committed: int, slices: Iterable[int] | None = None) -> dict[Cell, int]:
        return {cell: max(v for v in vs if v <= committed) for cell, vs in self.versions(slices).items() if min(vs) <= committed}

    def read(self, cells: dict[Cell, int]) -> DataFrame:
        """The rows of some cells, with ``_slice`` and ``_bucket``."""
        if not cells:
            return no_rows(self.spark, with_columns(self.schema, _slice="long", _bucket="integer"))
        paths = [f"{self.folder.path}/slice={s}/bucket={b}/v={v}" for (s, b), v in sorted(cells.items())]
        rows = self.spark.read.schema(with_columns(self.schema, slice="long", bucket="integer", v="long")).option(
            "basePath", self.folder.path).parquet(*paths)
        return rows.withColumnRenamed("slice", "_slice").withColumnRenamed("bucket", "_bucket").drop("v")

    def write(self, rows: DataFrame, version: int) -> None:
        """New versions of the cells that ``rows`` (with ``_slice``, ``_bucket``) belong to; one file a cell at least."""
        rows.select(*self.schema.names, F.col("_slice").alias("slice"), F.col("_bucket").alias("bucket"), F.lit(version).cast("long").alias("v")).repartition(
            "slice", "bucket").write.mode("append").partitionBy("slice", "bucket", "v").option("compression", "zstd").parquet(self.folder.path)

    def clear(self, cells: Iterable[Cell], keep: int) -> None:
        """Drop all versions of cells but one."""
        cells = set(cells)
        for (s, b), vs in self.versions({s for s, _ in cells}).items():
            for v in vs:
                if (s, b) in cells and v != keep:
                    self.folder.delete(f"/slice={s}/bucket={b}/v={v}")

    def undo(self, version: int) -> None:
        """Drop what a failed run of a batch left."""
        for path in self.folder.match(f"/slice=*/bucket=*/v={version}"):
            self.folder.delete(f"/{path}")


class Commits:
    """What counts, as marker files ``<version>,<batch>,<stream>``: versions number all batches of all streams into a table,
    batch numbers are a stream's own. One marker a stream is kept."""

    def __init__(self, spark: SparkSession, base: str):
        self.folder = Folder(spark, f"{base}/_done")

    def _all(self) -> list[tuple[int, int, str]]:
        parts = [p.split(",", 2) for p in self.folder.match("/*")]
        return [(int(v), int(n), stream) for v, n, stream in parts]

    def last(self) -> int:
        return max((v for v, _, _ in self._all()), default=-1)

    def next(self, stream: str, batch: int) -> int | None:
        """The version to write a batch as; None if it counts already."""
        seen = self._all()
        if any(s == stream and n >= batch for _, n, s in seen):
            return None
        return max((v for v, _, _ in seen), default=-1) + 1

    def add(self, version: int, stream: str, batch: int) -> None:
        before = [x for x in self._all() if x[2] == stream]
        self.folder.mark(f"/{version},{batch},{stream}")
        for v, n, s in before:
            self.folder.delete(f"/{v},{n},{s}")


def stream_of(batch: DataFrame) -> str:
    """The stream that a batch belongs to; the same after a restart from its checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
