"""Ordered operators per key that hold when one key owns a third of the table.

A plain window over a key puts all rows of that key into one task. Keys of up to ``slice_rows`` rows are left to such
a window. Longer keys are cut into slices of their unique, increasing position, about ``slice_rows`` rows each, and the same window runs
inside a slice; what has to cross a border is one small row per slice, found with a partial
aggregate over the rows of long keys only and carried over the slices of a key. So rows are shuffled once, nothing is checkpointed,
and the tables met on the way hold one row per ``slice_rows`` rows of the input: that bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from vetline.session import cut_lineage, stored

SLICE_ROWS = 1 << 20
SLICE = "_slice"


def with_slice(df: DataFrame, position: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add the slice number of a non-negative integer position."""
    return df.withColumn(SLICE, F.floor(F.col(position) / F.lit(slice_rows)).cast("bigint"))


def with_cut(df: DataFrame, keys: Sequence[str], position: str, slice_rows: int, ahead: Sequence[str] = ()) -> DataFrame:
    """Add ``_cut``: the slice of a row (behind the ``ahead`` columns) where its key is long, else null.

    A long key gets as many slices of equal width as it has ``slice_rows`` rows, so there are at most
    two slices for each ``slice_rows`` rows of the table.
    """
    lo, n = F.min(position), F.count(F.lit(1))
    width = F.greatest(F.lit(1), F.ceil((F.max(position) - lo + 1) / F.ceil(n / slice_rows)))
    long = (df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(n.alias("_n"), lo.alias("_lo"), width.alias("_width"))
            .filter(F.col("_n") > slice_rows).drop("_n"))
    at = F.floor((F.col(position) - F.col("_lo")) / F.col("_width")).cast("bigint")
    met = df.join(F.broadcast(long), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
    return met.withColumn("_cut", F.when(F.col("_lo").isNotNull(), F.struct(*ahead, at.alias(SLICE)))).select(*df.columns, "_cut")


def _carried(out: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with what their slice is handed from the slices before; one carry row a slice of a long key."""
    right = carry.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, "_cut")], *[c for c in carry.columns if c not in (*keys, "_cut")])
    return out.join(F.broadcast(right), [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (*keys, "_cut")], "left")


def _attach(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, SLICE]]
    left = [F.col(f"l.{c}") for c in df.columns]
    right = [F.col(f"r.{c}") for c in carry.columns if c not in (*keys, SLICE)]
    return df.alias("l").join(carry.alias("r"), on, "left").select(*left, *right)


def with_lag(df: DataFrame, keys: Sequence[str], position: str, cols: Sequence[str],
             slice_rows: int = SLICE_ROWS, prefix: str = "prev_") -> DataFrame:
    """The previous row's ``cols`` within a key, in order of ``position``."""
    cut = with_cut(df, keys, position, slice_rows)
    row = F.struct(*[F.col(c) for c in cols])
    earlier = W.partitionBy(*keys).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    tails = cut.filter("_cut is not null").groupBy(*keys, "_cut").agg(F.max_by(row, F.col(position)).alias("_tail"))
    carry = tails.select(*keys, "_cut", F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"))
    inside = W.partitionBy(*keys, "_cut").orderBy(position)
    out = _carried(cut.withColumn("_lag", F.lag(row).over(inside)), carry, keys).withColumn("_prev", F.coalesce("_lag", "_carry"))
    return out.select(*df.columns, *[F.col(f"_prev.{c}").alias(prefix + c) for c in cols])


def with_rank(df: DataFrame, keys: Sequence[str], position: str, slice_rows: int = SLICE_ROWS,
              name: str = "rank", ahead: Sequence[str] = ()) -> DataFrame:
    """1-based rank of a row within its key, in order of the ``ahead`` columns and then ``position``."""
    cut = with_cut(df, keys, position, slice_rows, ahead)
    earlier = W.partitionBy(*keys).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    sizes = cut.filter("_cut is not null").groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    carry = sizes.select(*keys, "_cut", F.sum("_n").over(earlier).alias("_before"))
    inside = W.partitionBy(*keys, "_cut").orderBy(*ahead, position)
    out = _carried(cut.withColumn("_in", F.row_number().over(inside)), carry, keys)
    return out.select(*df.columns, (F.coalesce("_before", F.lit(0)) + F.col("_in")).cast("bigint").alias(name))


def with_earlier_max(df: DataFrame, keys: Sequence[str], position: str, exprs: dict[str, Column],
                     slice_rows: int = SLICE_ROWS) -> DataFrame:
    """For every row the maximum of each expression over the *earlier* rows of its key."""
    cut = with_cut(df, keys, position, slice_rows)
    valued = cut.withColumns({f"_v_{n}": e for n, e in exprs.items()})
    earlier = W.partitionBy(*keys).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    tails = valued.filter("_cut is not null").groupBy(*keys, "_cut").agg(*[F.max(f"_v_{n}").alias(f"_t_{n}") for n in exprs])
    carry = tails.select(*keys, "_cut", *[F.max(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in exprs])
    inside = W.partitionBy(*keys, "_cut").orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    within = valued.withColumns({f"_w_{n}": F.max(f"_v_{n}").over(inside) for n in exprs})
    return _carried(within, carry, keys).select(*df.columns, *[F.greatest(f"_w_{n}", f"_c_{n}").alias(n) for n in exprs])


def with_segment(df: DataFrame, keys: Sequence[str], position: str, segment_rows: int,
                 slice_rows: int | None = None, quiet: tuple[str, int] | None = None) -> tuple[DataFrame, int]:
    """Cut keys of more than ``segment_rows`` rows into sessions and these into segments.

    ``quiet`` (column, gap) tells where a key may be cut for good: at a slice whose first row lies the gap or
    more behind all rows before it. The parts, sessions, do not depend on one another. A session longer than ``segment_rows`` has
    consecutive segments of about so many rows, never more than segment_rows + slice_rows.
    Adds ``_session`` and ``_seg``, both 0 for shorter keys, and returns the number of segments of the longest session.
    What decides is one row per key and slice; rows meet only the slices of long keys.
    """
    slice_rows = slice_rows or max(1, segment_rows // 4)
    sliced = with_slice(df, position, slice_rows)
    ends = [] if quiet is None else [F.max(quiet[0]).alias("_hi"), F.min_by(quiet[0], position).alias("_lo")]
    counts = sliced.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"), *ends)
    whole = W.partitionBy(*keys)
    before = whole.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    cut = F.lit(False) if quiet is None else F.coalesce(F.col("_lo") - F.max("_hi").over(before) >= quiet[1], F.lit(False))
    sessions = counts.withColumns({"_all": F.sum("_n").over(whole), "_cut": cut.cast("int")}).filter(F.col("_all") > segment_rows).withColumn(
        "_session", F.sum("_cut").over(whole.orderBy(SLICE)))
    inside = W.partitionBy(*keys, "_session").orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    segments = stored(sessions.select(*keys, SLICE, F.col("_session").cast("bigint").alias("_session"), F.floor(
        F.coalesce(F.sum("_n").over(inside), F.lit(0)) / F.lit(segment_rows)).cast("int").alias("_seg")), "segments")
    longest = segments.agg(F.max("_seg")).first()[0] or 0
    return _attach(sliced, segments, keys).drop(SLICE).na.fill(0, ["_session", "_seg"]), longest + 1


def global_sequence(df: DataFrame, order: Sequence[str], name: str = "seq") -> DataFrame:
    """Dense 1-based numbering of all rows in order, without a one-task window.

    Rows are range partitioned, sorted there, and written once so that the split stays fixed; a row's number is
    its place in its partition plus the rows of the partitions before, which come from a table of one row per
    partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                         .withColumn("_id", F.monotonically_increasing_id()))
    # the id holds the partition above bit 33 and the place in it below
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_in": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1})
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(before, "_part").select(*df.columns, (F.col("_before") + F.col("_in")).alias(name))
