"""Set operations on relations and arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_lines(a: Column, b: Column) -> Column:
    """Lines of ``a`` followed by the new ones of ``b``, each once, in order."""
    return F.array_distinct(F.concat(a, b))


def prepend_if_absent(items: Column, item: Column, present: Column) -> Column:
    return F.when(present, items).otherwise(F.concat(F.array(item), items))
