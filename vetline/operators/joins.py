"""Lookups, assembly, verification and duplicates. Broadcasts are left to the optimizer's size check."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline.functions.text import fold_number
from vetline.operators.filters import station


def watchlist_hits(docs: DataFrame, watchlist: DataFrame, number: str) -> DataFrame:
    """Documents whose normalised number is listed; the entry's status is not looked at."""
    wl = watchlist.select(F.col("document_id").alias("_listed"), F.col("full_name").alias("listed_name"),
                          "risk_category")
    probe = docs.filter(F.col(number).isNotNull()).withColumn("document_number", fold_number(F.col(number)))
    return probe.join(wl, F.col("document_number") == F.col("_listed")).drop("_listed")


SECTION = {"position": "bigint", "code": "string", "detail": "string", "score": "double", "at": "timestamp"}


def section(name: str, df: DataFrame, key: str = "screening_id", **columns: Column) -> DataFrame:
    """Rows of one kind in the dossier's typed columns; those not given are null, the position is 0."""
    columns = {"position": F.lit(0), **columns}
    return df.select(F.col(key).alias("case_id"), F.lit(name).alias("section"), *[
        columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in SECTION.items()])


def dossier(parents: DataFrame, children: Sequence[DataFrame]) -> DataFrame:
    """All rows of a case in long form: the ``section`` of the parents and those of the children that belong to one.

    Rows stay rows, so a case with many children is never gathered into one value. The children stream past a
    hash table of a partition's case ids and are never sorted: a task holds ids of parents, not children.
    For one case, filter the inputs first.
    """
    rows = reduce(DataFrame.unionByName, children)
    known = parents.select("case_id").hint("shuffle_hash")
    return parents.unionByName(rows.join(known, "case_id", "left_semi"))


def verify_digests(evidence: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Compare presented digests with registered ones; five outcomes including 'not registered'."""
    reg = registry.select(key, F.col("document_hash").alias("_reg_doc"), F.col("result_hash").alias("_reg_res"))
    doc = F.col("_reg_doc") == F.lower(F.trim("document_hash"))
    res = F.col("_reg_res") == F.lower(F.trim("result_hash"))
    outcome = (F.when(F.col("_reg_doc").isNull(), "NOT_ANCHORED").when(doc & res, "VERIFIED")
               .when(~doc & ~res, "BOTH_MISMATCH").when(~doc, "DOCUMENT_MISMATCH").otherwise("RESULT_MISMATCH"))
    return evidence.join(reg, key, "left").select(
        key, F.coalesce(doc, F.lit(False)).alias("document_hash_matches"),
        F.coalesce(res, F.lit(False)).alias("result_hash_matches"), outcome.alias("outcome"))


def unanchored(screenings: DataFrame, registry: DataFrame, key: str, registry_key: str) -> DataFrame:
    return screenings.join(registry.select(F.col(registry_key).alias(key)), key, "left_anti")


def missing_kinds(rows: DataFrame, entity: str, kind: str, expected: list[str]) -> DataFrame:
    """Expected kinds an entity has no row of, from one pass of flags per entity."""
    flags = rows.groupBy(entity).agg(*[F.max(F.col(kind) == k).alias(k) for k in expected])
    lacking = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(k), F.lit(False)), k) for k in expected]))
    return flags.select(entity, F.explode(lacking).alias("missing_kind"))


def first_seen(df: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """Flag the first row of each digest and link the others to it.

    The first row is a partial aggregate; the join back has one build row per
    digest, so a digest shared by a third of the rows only makes a skewed probe
    side, which is split at run time.
    """
    lead = df.groupBy(digest).agg(F.min(F.struct(*order)).alias("_first"))
    is_dup = F.struct(*[F.col(c) for c in order]) != F.col("_first")
    return df.join(lead, digest).withColumn("is_duplicate", is_dup).withColumn(
        "duplicate_of", F.when(is_dup, F.col(f"_first.{order[-1]}"))).drop("_first")


def distinct_by(df: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """One row per digest, the first in order."""
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    best = df.groupBy(digest).agg(F.min_by(row, F.struct(*order)).alias("r"))
    return best.select(*[F.col(f"r.{c}").alias(c) for c in df.columns])


def with_operator(screenings: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select(F.col("id").alias("operator_id"), F.col("username").alias("operator_name"))
    return screenings.join(u, "operator_id", "left").withColumn(
        "operator_name", F.coalesce("operator_name", F.lit("SYSTEM")))


def binding_violations(logins: DataFrame, users: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Refused logins with their reason: unknown or inactive user, unusable or foreign station."""
    u = users.select(F.col("username").alias("_u"), F.col("is_active").alias("_ua"),
                     F.trim("checkpoint_id").alias("_us"))
    c = checkpoints.select(F.col("id").alias("_c"), F.col("is_active").alias("_ca"), F.col("username").alias("_cu"))
    claim = station(F.col("claimed_checkpoint"))
    out = logins.withColumn("_claim", claim).join(u, F.trim("username") == F.col("_u"), "left").join(
        c, F.col("_claim") == F.col("_c"), "left")
    reason = (F.when(F.col("_u").isNull(), "Invalid credentials").when(~F.col("_ua"), "User account deactivated")
              .when(F.col("_claim").isNotNull() & ~F.coalesce("_ca", F.lit(False)), "Invalid checkpoint credentials")
              .when(F.col("_claim").isNotNull() & (F.coalesce("_us", F.lit("")) != F.col("_c"))
                    & (F.col("_u") != F.col("_cu")), "Checkpoint-user binding mismatch"))
    return out.withColumn("reason", reason).filter("reason is not null").select(*logins.columns, "reason")


def mutation_report(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Planned change per case next to what was found."""
    found = (F.col("mismatched_fields") > 0)
    return expected.join(observed, "case_id").select(
        "case_id", "category", "target_field",
        F.when(found, F.concat(F.lit("Discrepancy detected in "), "target_field")).otherwise(
            F.lit("Forensic anomaly flagged")).alias("detected_change"),
        F.when(found | (F.col("risk_score") > 30), "DETECTED").otherwise("FLAGGED").alias("detection_status"))


def append_once(existing: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``incoming`` to append so that every key is stored once; the first in order wins.
    A null key is one key: it is stored once as well."""
    known = existing.select(F.col(key).alias("_known"))
    return distinct_by(incoming.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti"), key, order)
