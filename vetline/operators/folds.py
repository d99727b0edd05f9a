"""Sequential folds per key: hash chains and accepted-only quotas.

Both depend on the outcome of the row before, so a key's history has to be
walked in order. Rows are hashed to tasks by key and sorted there; the walk
keeps one small state and streams Arrow batches, it never holds a group. A key
with more than ``segment_rows`` rows is cut where its state is empty anyway, at gaps
as long as the quota's window, and the parts are walked side by side. Only what has no such gap, a
hash chain or a key that never rests, is walked in segments one after the other, with the
state of the key handed on, so no task gets more than a segment of one key.

A ``Fold`` can also start from given states; the streams use that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vetline.functions.digest import GENESIS, sha256_hex, utc_seconds
from vetline.operators.ordered import with_segment
from vetline.session import scratch_path

SEGMENT_ROWS = 4_000_000
_NO_KEY = object()      # equals no key, null included


@dataclass(frozen=True)
class Fold:
    """A walk over the rows of a key in order of position, from a state to a state."""
    key: str
    position: str
    columns: list[str]          # of the rows
    schema: str                 # of the walked rows, without the state behind each
    state_type: str
    prepare: Callable[[DataFrame], DataFrame]
    walker: Callable[[list[str], bool], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]

    def run(self, rows: DataFrame, with_state: bool = False, also: Sequence[str] = ()) -> DataFrame:
        """Walk ``rows``, which carry the state that their key starts from in ``_state`` (null: none) and the part of
        their key that they are walked with in ``_session``. With ``with_state`` each row also gets the state behind it."""
        ready = self.prepare(rows)
        extra = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in also)
        schema = self.schema + extra + (f", _state {self.state_type}" if with_state else "")
        return ready.repartition(self.key, "_session").sortWithinPartitions(self.key, "_session", self.position).mapInArrow(
            self.walker([*self.columns, *also], with_state), schema)

    def ends(self, walked: DataFrame, *by: str) -> DataFrame:
        """The state behind the last row of each key."""
        return walked.groupBy(self.key, *by).agg(F.max_by("_state", self.position).alias("_state"))

    def start(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_state", F.lit(None).cast(self.state_type))


def same_key(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Join on a key that may be null."""
    renamed = right.withColumnRenamed(key, "_k")
    return left.join(renamed, left[key].eqNullSafe(renamed["_k"]), how).drop("_k")


def _batch(batch: pa.RecordBatch, names: Sequence[str], more: dict[str, pa.Array], order: Sequence[str]) -> pa.RecordBatch:
    """Columns pass as they are, so no integer takes a detour over floats."""
    at = {**{c: batch.column(c) for c in names}, **more}
    return pa.RecordBatch.from_arrays([at[c] for c in order], list(order))


def _fold(df: DataFrame, fold: Fold, segment_rows: int, quiet: tuple[str, int] | None = None) -> DataFrame:
    rows, rounds = with_segment(df, [fold.key], fold.position, segment_rows, quiet=quiet)
    rows = rows.drop(*([quiet[0]] if quiet else []))
    if rounds == 1:
        return fold.run(fold.start(rows))
    spark = df.sparkSession
    cut, done = scratch_path(spark, "segments"), scratch_path(spark, "walked")
    rows.write.partitionBy("_seg").parquet(cut)
    part_of = spark.read.schema(rows.drop("_seg").schema).parquet
    starts = None
    for r in range(rounds):
        part = part_of(f"{cut}/_seg={r}")
        if starts is None:
            part = fold.start(part)
        else:
            on = [part[c].eqNullSafe(starts[c]) for c in (fold.key, "_session")]
            part = part.join(starts, on, "left").select(*[part[c] for c in part.columns], starts["_state"])
        fold.run(part, True, ["_session"]).write.parquet(f"{done}/_seg={r}")
        starts = fold.ends(spark.read.parquet(f"{done}/_seg={r}"), "_session")
    return spark.read.parquet(done).drop("_seg", "_state", "_session")


def _types(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def chain_fold(schema: StructType, key: str = "chain_id", position: str = "id") -> Fold:
    """Link each event to the hash of the one before it in its chain; the state is the last hash."""
    def prepare(rows: DataFrame) -> DataFrame:
        return rows.withColumn("payload_hash", F.sha2("payload", 256)).withColumns({
            "_left": F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|")),
            "_right": F.concat_ws("|", F.lit(""), utc_seconds(F.col("ts")), "actor", "event_type", "payload_hash"),
        })

    def walker(names: list[str], with_state: bool):
        own = [c for c in names if c in schema.names]
        order = [*own, "payload_hash", "previous_hash", "event_hash", *[c for c in names if c not in own], *["_state"] * with_state]

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, head = _NO_KEY, GENESIS
            for batch in batches:
                previous, hashes = [], []
                for *k, left, right, start in zip(*[batch.column(c).to_pylist() for c in (key, "_session", "_left", "_right", "_state")]):
                    if k != current:
                        current, head = k, start or GENESIS
                    previous.append(head)
                    head = hashlib.sha256((left + head + right).encode()).hexdigest()
                    hashes.append(head)
                after = pa.array(hashes, pa.string())
                yield _batch(batch, [*names, "payload_hash"], {"previous_hash": pa.array(previous, pa.string()), "event_hash": after, "_state": after}, order)
        return walk

    return Fold(key, position, schema.names, _types(schema) + ", payload_hash string, previous_hash string, event_hash string", "string",
                prepare, walker)


def build_chain(events: DataFrame, key: str = "chain_id", position: str = "id",
                segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Link each event to the hash of the one before it in its chain.

    ``events`` needs key, position, ts, actor, event_type and payload (canonical
    text). Adds payload_hash, previous_hash and event_hash.
    """
    return _fold(events, chain_fold(events.schema, key, position), segment_rows)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def throttle_fold(schema: StructType, key: str, position: str, ts: str, limit: int, seconds: int) -> Fold:
    """Mark events under a sliding quota; the state is the times of the accepted events in the window."""
    window = seconds * 1_000_000

    def walker(names: list[str], with_state: bool):
        own = [c for c in names if c in schema.names]
        order = [*own, "accepted", *[c for c in names if c not in own], *["_state"] * with_state]

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, kept = _NO_KEY, []
            for batch in batches:
                flags, states = [], []
                for *k, t, start in zip(*[batch.column(c).to_pylist() for c in (key, "_session", "_t", "_state")]):
                    if k != current:
                        current, kept = k, list(start or ())
                    if t is None:
                        flags.append(False)
                    else:
                        kept = [x for x in kept if x > t - window]
                        flags.append(len(kept) < limit)
                        if flags[-1]:
                            kept.append(t)
                    if with_state:
                        states.append(list(kept))
                more = {"accepted": pa.array(flags, pa.bool_())}
                if with_state:
                    more["_state"] = pa.array(states, pa.list_(pa.int64()))
                yield _batch(batch, names, more, order)
        return walk

    return Fold(key, position, schema.names, _types(schema) + ", accepted boolean", "array<bigint>",
                lambda rows: rows.withColumn("_t", _micros(ts)), walker)


def throttle(events: DataFrame, key: str, position: str, ts: str, limit: int, seconds: int,
             segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Mark each event accepted or denied under a sliding quota.

    An event is denied when ``limit`` accepted events lie strictly inside the last
    ``seconds``; denied events use no quota. An event without a time is denied. Adds column ``accepted``.
    """
    fold = throttle_fold(events.schema, key, position, ts, limit, seconds)
    return _fold(events.withColumn("_at", _micros(ts)), fold, segment_rows, ("_at", seconds * 1_000_000))


def event_hash(key: Column) -> Column:
    """The hash an event should carry, from its own columns."""
    return sha256_hex(F.concat_ws("|", key.cast("string"), "previous_hash", utc_seconds(F.col("ts")), "actor",
                                  "event_type", "payload_hash"))


__all__: Sequence[str] = ["Fold", "build_chain", "chain_fold", "throttle", "throttle_fold", "event_hash"]
