"""Tokens, lines, regions and grids of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from vetline.functions.numeric import clone_anomaly, fixed_round, noise_anomaly
from vetline.operators.ordered import global_sequence

LINE_KEY = ["page", "block_num", "par_num", "line_num"]
TEXT_SLICE = 4096
MEDIAN_ACCURACY = 10000


def lines_from_tokens(tokens: DataFrame, key: list[str] = LINE_KEY, slice_width: int = TEXT_SLICE) -> DataFrame:
    """One row per line: text in order of x, mean confidence (0..1) and the box around its tokens.

    Texts are joined in two steps, first inside slices of x, so that gathering stays small.
    """
    part = tokens.withColumn("_s", F.floor(F.col("x") / slice_width))
    words = F.sort_array(F.collect_list(F.struct("x", "tie", "text")))
    sliced = part.groupBy(*key, "_s").agg(
        F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("_t"), F.count(F.lit(1)).alias("n_tokens"),
        F.sum("conf").alias("_c"), F.min("x").alias("left"), F.min("y").alias("top"),
        F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"))
    parts = F.sort_array(F.collect_list(F.struct("_s", "_t")))
    out = sliced.groupBy(*key).agg(
        F.array_join(F.transform(parts, lambda p: p["_t"]), " ").alias("text"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("_c").alias("_c"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"),
        F.max("bottom").alias("bottom"))
    return out.withColumn("confidence", fixed_round(F.col("_c") / F.col("n_tokens") / 100, 4)).drop("_c")


def line_confidence(tokens: DataFrame, key: list[str] = LINE_KEY) -> DataFrame:
    """Only the line's mean confidence of ``lines_from_tokens``: no text, so no slices, one row of sums a line."""
    sums = tokens.groupBy(*key).agg(F.sum("conf").alias("_c"), F.count(F.lit(1)).alias("_n"))
    return sums.select(*key, fixed_round(F.col("_c") / F.col("_n") / 100, 4).alias("confidence"))


def reading_order(lines: DataFrame, page: str = "page") -> DataFrame:
    """Pages in order, lines by top edge, then left edge; ``place`` is the line's number over all pages."""
    order = [page, "top", "left", *[c for c in LINE_KEY if c in lines.columns and c != page]]
    return global_sequence(lines, order, "place").orderBy("place")


def page_confidence(lines: DataFrame, page: str = "page") -> DataFrame:
    return lines.groupBy(page).agg(F.coalesce(fixed_round(F.avg("confidence"), 3), F.lit(0.0)).alias("average_confidence"),
                                   F.count(F.lit(1)).alias("total_lines"))


def region_order(regions: DataFrame, filename: str, role: str, key: str) -> DataFrame:
    """Regions sorted so that first copies and base pictures come before variants; ``place`` is the number of a
    region, ties by ``key``."""
    f = F.col(filename)
    marked = regions.withColumns({
        "is_media": f.contains("media_").cast("int"), "base_name": F.regexp_replace(f, r"\s*\(\d+\)", ""),
        "has_copy_number": f.contains(" (").cast("int"), "is_variant": (F.col(role) == "VISA_VARIANT").cast("int"),
    })
    order = ["is_media", "base_name", "has_copy_number", filename, "is_variant", key]
    return global_sequence(marked, order, "place").orderBy("place")


def primary_region(regions: DataFrame, group: str, frame_width: int, tie: str, left_part: float = 0.55) -> DataFrame:
    """Largest region per group; on documents one in the left part is preferred."""
    left = F.col("is_document") & ((F.col("x") + F.col("w") / 2) < frame_width * left_part)
    worth = F.struct(left, F.col("w") * F.col("h"), -F.col(tie))
    best = regions.groupBy(group).agg(F.max_by(F.struct("x", "y", "w", "h"), worth).alias("r"))
    return best.select(group, "r.*")


def exact_median(df: DataFrame, key: str, value: str, accuracy: int = MEDIAN_ACCURACY) -> DataFrame:
    """(key, median, max_value, std) without gathering a group, exact for any distribution.

    A mergeable quantile summary brackets the middle ranks of a key within a few in
    ``accuracy`` of its rows; only the distinct values inside the bracket are ranked one by one,
    everything below is a single count. Keys of up to ``accuracy`` rows need no bracket.
    """
    v = F.col(value)
    margin = 2.0 / accuracy
    ends = df.groupBy(key).agg(
        F.count(v).alias("n"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.stddev_pop(v).alias("std"),
        F.percentile_approx(v, [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin)], accuracy).alias("_q"))
    few = F.col("n") <= accuracy
    bounds = ends.select(key, "n", F.when(few, F.col("min_value")).otherwise(F.col("_q")[0]).alias("_lo"),
                         F.when(few, F.col("max_value")).otherwise(F.col("_q")[1]).alias("_hi"))
    near = df.join(bounds, key).filter(v <= F.col("_hi"))
    counts = near.groupBy(key, "n", F.when(v >= F.col("_lo"), v).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    cum = W.partitionBy(key).orderBy(F.asc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = counts.withColumn("_upto", F.sum("_c").over(cum))

    def at(rank):
        return F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    mid = counts.groupBy(key).agg(((at(lower) + at(upper)) / 2).alias("median"))
    return mid.join(ends.select(key, "max_value", "std"), key)


def grid_outliers(cells: DataFrame, key: str, value: str) -> DataFrame:
    """Per item the cells far from its median, and the anomaly score of their spread."""
    stats = exact_median(cells, key, value)
    v = F.col(value)
    odd = (v > F.col("median") + 2.0 * F.col("std")) | (v < F.col("median") - 1.8 * F.col("std"))
    out = cells.join(stats, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(odd).alias("outliers"), F.max("median").alias("median"),
        F.max("max_value").alias("max_value"), F.max("std").alias("std"))
    score = noise_anomaly(F.col("max_value"), F.col("median"), F.col("std"))
    return out.select(key, "cells", "outliers", fixed_round(F.col("median"), 3).alias("median"),
                      score.alias("anomaly_score"))


def displacement_clusters(pairs: DataFrame, key: str, bin_width: float = 25.0, least_pairs: int = 5,
                          least_cluster: int = 4) -> DataFrame:
    """Largest group of like displacements per item, 0 when there are too few, and the clone score."""
    bins = pairs.groupBy(key, F.floor(F.col("dx") / bin_width).alias("bx"), F.floor(F.col("dy") / bin_width).alias("by_")).agg(
        F.count(F.lit(1)).alias("n"))
    out = bins.groupBy(key).agg(F.sum("n").alias("pairs"), F.max("n").alias("largest"))
    coherent = F.when((F.col("pairs") >= least_pairs) & (F.col("largest") >= least_cluster), F.col("largest")).otherwise(F.lit(0))
    return out.select(key, "pairs", coherent.alias("coherent"), clone_anomaly(coherent, F.col("pairs")).alias("anomaly_score"))
