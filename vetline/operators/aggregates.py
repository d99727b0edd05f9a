"""Counts, rates, distributions and evaluation figures. All aggregate before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from vetline.functions.numeric import fixed_round
from vetline.operators.filters import REVIEW_STATUSES, RISK_LEVELS


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def band_counts(df: DataFrame, column: str = "risk_band", domain: list[str] = RISK_LEVELS) -> DataFrame:
    """Count per value of a fixed domain, zero-filled; other values are dropped."""
    counts = df.agg(*[F.count_if(F.col(column) == v).alias(v) for v in domain])
    rows = [F.struct(F.lit(v).alias("band"), F.col(v).alias("count")) for v in domain]
    return counts.select(F.inline(F.array(*rows)))


def rate_pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return fixed_round(part / F.greatest(whole, F.lit(1)) * 100, digits)


def average_or_zero(c: Column, digits: int = 1) -> Column:
    return F.coalesce(fixed_round(F.avg(c), digits), F.lit(0.0))


def summary(screenings: DataFrame) -> DataFrame:
    """Total, reviews, review rate and mean latency in one pass."""
    reviews = F.count_if(F.col("status").isin(*REVIEW_STATUSES))
    return screenings.agg(
        F.count(F.lit(1)).alias("total_screenings"), reviews.alias("manual_reviews_required"),
        average_or_zero(F.col("execution_latency_ms")).alias("average_latency_ms"),
    ).withColumn("manual_review_rate_pct", rate_pct(F.col("manual_reviews_required"), F.col("total_screenings")))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share in percent per value."""
    whole = df.select(F.count(F.lit(1)).alias("n")).scalar()
    return counts_by(df, column).withColumn("share_pct", fixed_round(F.col("count") / whole * 100, 1))


def stage_stats(df: DataFrame, stage: str, value: str) -> DataFrame:
    return df.groupBy(stage).agg(fixed_round(F.avg(value), 4).alias("mean"),
                                 fixed_round(F.stddev_pop(value), 4).alias("std"))


def stage_share(df: DataFrame, stage: str, value: str) -> DataFrame:
    """Cost per stage and its share of the total."""
    whole = df.select(F.sum(value).alias("s")).scalar()
    cost = df.groupBy(stage).agg(F.sum(value).alias("cost"))
    share = F.when(whole > 0, F.col("cost") / whole * 100).otherwise(F.lit(0.0))
    return cost.select(stage, fixed_round(F.col("cost"), 2).alias("cost"), fixed_round(share, 1).alias("share_pct"))


def rank_stages(df: DataFrame, stage: str, value: str, k: int = 5) -> DataFrame:
    """The k most expensive stages, numbered. Only k rows reach the numbering."""
    top = df.groupBy(stage).agg(fixed_round(F.sum(value), 2).alias("cost")).orderBy(
        F.desc("cost"), stage).limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("cost"), stage)))


def binary_eval(df: DataFrame, expected: Column, detected: Column) -> DataFrame:
    """Confusion counts, precision, recall and F1 with guarded denominators."""
    counts = df.agg(F.count_if(expected & detected).alias("tp"), F.count_if(~expected & detected).alias("fp"),
                    F.count_if(expected & ~detected).alias("fn"), F.count_if(~expected & ~detected).alias("tn"))
    one = F.lit(1)
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one)
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)
    out = counts.withColumns({"_p": p, "_r": r})
    f1 = 2 * F.col("_p") * F.col("_r") / F.greatest(F.col("_p") + F.col("_r"), F.lit(1e-6))
    return out.select("tp", "fp", "fn", "tn", fixed_round(F.col("_p"), 3).alias("precision"),
                      fixed_round(F.col("_r"), 3).alias("recall"), fixed_round(f1, 3).alias("f1"))


def mrz_accuracy(decoded: DataFrame, checks: list[str]) -> DataFrame:
    """Parse rate and share of valid check digits over parsed lines, in percent."""
    valid = sum((F.when(F.try_element_at("checks", F.lit(c))["valid"], 1).otherwise(0) for c in checks), F.lit(0))
    counts = decoded.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("parsed").alias("parsed_count"),
        F.coalesce(F.sum(F.when(F.col("parsed"), valid)), F.lit(0)).alias("valid_checks"))
    return counts.select(
        "total", "parsed_count", "valid_checks", rate_pct(F.col("parsed_count"), F.col("total")).alias("parse_rate"),
        rate_pct(F.col("valid_checks"), F.col("parsed_count") * len(checks)).alias("check_accuracy"))


def pair_rates(df: DataFrame, same: Column, verdict: str) -> DataFrame:
    """Genuine match rate and impostor rejection rate."""
    v = F.col(verdict)
    c = df.agg(F.count_if(same & v.isin("MATCH", "BORDERLINE")).alias("true_matches"),
               F.count_if(same & ~v.isin("MATCH", "BORDERLINE")).alias("false_rejects"),
               F.count_if(~same & (v == "MISMATCH")).alias("true_rejections"),
               F.count_if(~same & (v == "MATCH")).alias("false_accepts"))
    return c.select("*", rate_pct(F.col("true_matches"), F.col("true_matches") + F.col("false_rejects")).alias(
        "match_rate"), rate_pct(F.col("true_rejections"), F.col("true_rejections") + F.col("false_accepts")).alias(
        "rejection_rate"))


def tamper_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("screening_id").agg(
        F.coalesce(F.max("score"), F.lit(0.0)).alias("composite_tamper_score"),
        F.count(F.lit(1)).alias("findings_count"))


def populated(columns: list[str]) -> Column:
    """How many of the columns hold a value in a row."""
    return sum((F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))


def verified_counts(rows: DataFrame, case: str = "case_id") -> DataFrame:
    ok = F.col("status").isin("MATCH", "VIZ_ONLY", "MRZ_ONLY")
    return rows.groupBy(case).agg(F.count_if(ok).alias("verified"), F.count(F.lit(1)).alias("checked"))


def eval_summary(cases: DataFrame) -> DataFrame:
    """Evaluation roll-up in one pass; plain counts, nothing is floored.

    Needs parent, person_id, document_type, role, pair_kind, pair_result, mismatched_fields,
    zone_failed, zone_discrepancies, tamper_score, status, anchored, verified.
    """
    c = F.col
    same, cross = c("pair_kind") == "SAME", c("pair_kind") == "CROSS"
    reference = c("role") == "REFERENCE"
    return cases.agg(
        F.count_distinct("parent").alias("parent_images"), F.count(F.lit(1)).alias("document_regions"),
        F.count_if(c("document_type") == "PASSPORT").alias("passports"),
        F.count_if((c("document_type") == "VISA") & reference).alias("visas"),
        F.count_if(c("role") == "VARIANT").alias("variants"), F.count_distinct("person_id").alias("people"),
        F.count_if(same).alias("same_person_pairs"), F.count_if(cross).alias("cross_person_pairs"),
        F.coalesce(F.sum("mismatched_fields"), F.lit(0)).alias("field_mismatches"),
        F.count_if("zone_failed").alias("zone_failures"),
        F.coalesce(F.sum("zone_discrepancies"), F.lit(0)).alias("zone_discrepancies"),
        F.count_if(same & (c("pair_result") == "MATCH")).alias("face_matches"),
        F.count_if(same & (c("pair_result") == "MISMATCH")).alias("face_mismatches"),
        F.count_if(c("tamper_score") > 30).alias("forensic_anomalies"),
        F.count_if(c("role") == "MUTATION").alias("tampering_cases"),
        F.count_if(c("status") == "UNABLE_TO_VERIFY").alias("unable_to_verify_cases"),
        F.count_if("anchored").alias("anchors"), F.count_if("verified").alias("audit_verifications"),
        F.count(c("status")).alias("evaluated_cases"))
