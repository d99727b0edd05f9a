"""Vectors as rows of (node, key, n, vec): distinct vectors with the ids that carry them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: str = "embedding") -> Column:
    """Not null or empty, no null or non-finite component, not zero."""
    return F.coalesce(F.expr(
        f"size({embedding}) > 0 and forall({embedding}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
        f"and exists({embedding}, x -> x <> 0)"), F.lit(False))


def packed(df: DataFrame, column: str = "embedding") -> DataFrame:
    """``column`` as the bytes of a double vector of length 1, named ``vec``."""
    names = [c for c in df.columns if c != column]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != column] + ["vec binary"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[names].copy()
            out["vec"] = [unit(x).tobytes() for x in frame[column]]
            yield out

    return df.select(*names, column).mapInPandas(run, schema)


def unit(x) -> np.ndarray:
    """Length 1 in double precision, without overflow on the way."""
    v = np.asarray(x, np.float64)
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def stacked(column) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float64) for b in column])
