"""The table of registered queries: a name, a Spark function, and where it can be said in SQL, the check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vetline.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}

AS_OF = "2026-07-01 12:00:00"


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists the inventory rows it shows."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)
        assert name not in QUERIES, name
        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def rnd(expr: str, digits: int) -> str:
    """SQL for the fixed rounding used everywhere."""
    return f"cast(round(cast({expr} as decimal(38,6)), {digits}) as double)"


def check_digit_sql(text: str) -> str:
    """SQL for a 7-3-1 check digit over any text."""
    return (f"cast(list_sum(list_transform(range(1, length({text})+1), lambda i: "
            f"greatest(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({text}, cast(i as bigint), 1)) - 1, 0) * "
            f"[7,3,1][cast((i-1)%3+1 as int)])) % 10 as varchar)")
