"""Sorting with a limit, pages and best rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

SEVERITY_ORDER = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "INFO": 4}


def severity_rank(c: Column) -> Column:
    out = F.lit(5)
    for name, rank in SEVERITY_ORDER.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def top_groups(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), column).limit(k)


def page(df: DataFrame, limit: int, offset: int, newest: str = "created_at", key: str = "id") -> DataFrame:
    """Newest first; limit is clamped to 1..100 and the offset to >= 0."""
    return df.orderBy(F.desc(newest), F.desc(key)).offset(max(0, offset)).limit(max(1, min(limit, 100)))


def head(df: DataFrame, limit: int, key: str = "id") -> DataFrame:
    return df.orderBy(key).limit(max(1, min(limit, 100)))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group. The optimizer cuts to k per task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def best_row(df: DataFrame, group: list[str], score: Column) -> DataFrame:
    """The row with the greatest score struct per group, as a partial aggregate."""
    cols = [c for c in df.columns if c not in group]
    best = df.groupBy(*group).agg(F.max_by(F.struct(*cols), score).alias("r"))
    return best.select(*group, *[F.col(f"r.{c}").alias(c) for c in cols])
