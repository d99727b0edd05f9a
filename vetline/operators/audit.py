"""Verification of hash chains: links, first break, genesis and head."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetline.functions.digest import GENESIS
from vetline.operators.folds import event_hash
from vetline.operators.ordered import SLICE_ROWS, with_lag


def chain_links(log: DataFrame, key: str = "chain_id", position: str = "id",
                slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per event: does previous_hash equal the hash before it, and is its own hash right."""
    linked = with_lag(log, [key], position, ["event_hash"], slice_rows, prefix="_before_")
    return linked.withColumns({
        "link_ok": F.col("previous_hash") == F.coalesce("_before_event_hash", F.lit(GENESIS)),
        "hash_ok": F.coalesce(F.col("event_hash") == event_hash(F.col(key)), F.lit(False)),
    }).drop("_before_event_hash")


def first_break(log: DataFrame, key: str = "chain_id", position: str = "id",
                slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per chain: valid or not, and the first faulty event. A link fault is
    reported before a hash fault of the same event."""
    links = chain_links(log, key, position, slice_rows)
    fault = F.when(~F.col("link_ok"), "LINK").when(~F.col("hash_ok"), "HASH")
    bad = F.when(fault.isNotNull(), F.struct(F.col(position), F.col("event_type"), fault.alias("fault")))
    out = links.groupBy(key).agg(F.count(F.lit(1)).alias("total_events"), F.min(bad).alias("bad"))
    return out.select(
        key, F.col("bad").isNull().alias("is_valid"), "total_events",
        F.col(f"bad.{position}").alias("tampered_at_event_id"), F.col("bad.event_type").alias("event_type"),
        F.col("bad.fault").alias("fault"))


def chain_summary(log: DataFrame, chains: DataFrame, key: str = "chain_id", position: str = "id") -> DataFrame:
    """Genesis, head and length per chain; chains without events have the genesis as head."""
    ends = log.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_events"), F.min_by("previous_hash", position).alias("genesis_hash"),
        F.max_by("event_hash", position).alias("head_hash"))
    zero = F.lit(GENESIS)
    return chains.select(key).join(ends, key, "left").select(
        key, F.coalesce("total_events", F.lit(0)).alias("total_events"),
        F.coalesce("genesis_hash", zero).alias("genesis_hash"), F.coalesce("head_hash", zero).alias("head_hash"))
