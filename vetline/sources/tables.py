"""Typed table scans and sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline import schemas
from vetline.session import stored
from vetline.sources.folders import Folder

PARENT = "screenings"
#: The folder of the markers of complete batches.
DONE = "_batches"


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A stored table under its fixed schema; columns that old files lack read as null."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{base}/{name}")


def write_manifest(df: DataFrame, path: str) -> None:
    """CSV with the manifest's columns in their order; other columns are left out."""
    df.select(*schemas.MANIFEST.fieldNames()).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_screenings(results: DataFrame, base: str, batch: str, period: str = "day") -> bool:
    """Split wide results into the parent and its child tables: all of a batch or nothing.

    Children are arrays of structs named after their table, so one case is one row until it is written. Every
    table gets the rows below ``batch=<id>/period=<p>``, and one marker makes them count, in all tables at once. A batch that
    failed between two tables is written anew over what it left; a batch that counts already is left alone (False).
    Rows are rebalanced by period: small periods share a task and a file, a large one is split over several.
    The results are computed once and kept for all tables.
    """
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"no name of a folder: {batch!r}")
    done = Folder(results.sparkSession, f"{base}/{DONE}")
    if done.exists(f"/{batch}"):
        return False
    dated = stored(results.withColumn("period", F.date_trunc(period, "created_at").cast("date")), "results")
    children = [c for c in results.columns if c in schemas.TABLES]

    def write(df: DataFrame, name: str) -> None:
        df.hint("rebalance", "period").write.mode("overwrite").partitionBy("period").parquet(f"{base}/{name}/batch={batch}")
    write(dated.drop(*children), PARENT)
    for c in children:
        write(dated.select(F.col("id").alias("screening_id"), "period", F.inline(c)), c)
    done.mark(f"/{batch}")
    return True


def read_screenings(spark: SparkSession, base: str, name: str = PARENT) -> DataFrame:
    """The rows of one of the tables that ``write_screenings`` fills, of complete batches only, with ``batch`` and ``period``."""
    complete = Folder(spark, f"{base}/{DONE}").match("/*")
    rows = spark.read.option("mergeSchema", "true").parquet(f"{base}/{name}").withColumn("batch", F.col("batch").cast("string"))
    return rows.filter(F.col("batch").isin(complete))
