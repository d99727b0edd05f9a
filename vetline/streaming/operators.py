"""Stateful stream operators: throttle, hash chain, at-most-once registration, watchlist check.

Throttle and chain keep their result as a table of cells (``folded``): a batch folds the keys it touches from
the state in front of its earliest row. A row that comes late or out of order is placed where it belongs, nothing
is dropped, and the table equals the batch operator's whatever files the rows came in. What a batch costs does not grow
with the history. A batch that runs again after a failure counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from vetline.operators.folds import Fold, chain_fold, throttle_fold
from vetline.operators.joins import watchlist_hits
from vetline.streaming.folded import BUCKETS, WIDTH, FoldedTable
from vetline.streaming.registered import Registry


def _drain(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _folded(stream: DataFrame, fold: Fold, path: str, checkpoint: str, width: int, buckets: int) -> DataFrame:
    table = FoldedTable(stream.sparkSession, path, fold, stream.schema, width, buckets)
    _drain(stream, table.apply, checkpoint)
    return table.read()


def throttle_stream(stream: DataFrame, key: str, position: str, ts: str, limit: int, seconds: int, path: str,
                    checkpoint: str, width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """Events of a stream marked accepted or denied."""
    return _folded(stream, throttle_fold(stream.schema, key, position, ts, limit, seconds), path, checkpoint, width, buckets)


def chain_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "chain_id", position: str = "id",
                 width: int = WIDTH, buckets: int = BUCKETS) -> DataFrame:
    """The events of a stream in their hash chains."""
    return _folded(stream, chain_fold(stream.schema, key, position), path, checkpoint, width, buckets)


def anchor_stream(stream: DataFrame, key: str, path: str, checkpoint: str, order: list[str]) -> DataFrame:
    """Register each key at most once in the table at ``path``, however late it comes, and return the table.

    Of the rows of one batch the first in ``order`` is registered. A key that is stored, null included, is left alone.
    """
    registry = Registry(stream.sparkSession, path, key, stream.schema)
    _drain(stream, lambda batch, number: registry.register(batch, number, order), checkpoint)
    return registry.read()


def watch_stream(stream: DataFrame, watchlist: DataFrame, number: str) -> DataFrame:
    """Hits of arriving documents on a static watchlist."""
    return watchlist_hits(stream, watchlist, number)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there, append it to a parquet table and return the table."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(
        "append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
