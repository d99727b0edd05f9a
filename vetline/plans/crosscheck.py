"""Comparing two readings of a document, linking two documents, and the rules that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline.functions.dates import is_past, strict_date, visa_date
from vetline.functions.fields import (
    DOCUMENT_CONTROL, IDENTITY_CRITICAL, LINKAGE_FIELDS, PASSPORT_FIELDS, VISA_FIELDS, backfill, compare_status,
    display_equal, normalised, record_equal, record_name, resolve, severity_of, usable)
from vetline.functions.text import any_token_shared, fold_number, full_name, token_set
from vetline.operators.joins import watchlist_hits


def _value(columns: list[str], field: str, extra: str) -> Column:
    if field == "name":
        return record_name(columns, extra)
    return F.col(field) if field in columns else F.lit(None).cast("string")


def paired(left: DataFrame, right: DataFrame, key: str, fields: list[str], left_extra: str = "full_name",
           right_extra: str = "full_name", how: str = "full") -> DataFrame:
    """One row per key with normalised l_<field>, r_<field>. Rows are joined while still wide,
    so the shuffle carries one row per document and side, not one per field."""
    a = left.select(key, *[normalised(f, _value(left.columns, f, left_extra)).alias(f"l_{f}") for f in fields])
    b = right.select(key, *[normalised(f, _value(right.columns, f, right_extra)).alias(f"r_{f}") for f in fields])
    return a.join(b, key, how)


def field_diff(reference: DataFrame, observed: DataFrame, key: str, kind: str = "PASSPORT") -> DataFrame:
    """One row per document and field: both values, status and severity."""
    fields = VISA_FIELDS if kind.upper() == "VISA" else PASSPORT_FIELDS
    pairs = paired(reference, observed, key, fields)
    status = {f: compare_status(f, F.col(f"l_{f}"), F.col(f"r_{f}")) for f in fields}
    rows = pairs.select(key, F.inline(F.array(*[F.struct(
        F.lit(f).alias("field"), F.coalesce(f"l_{f}", F.lit("UNKNOWN")).alias("reference_value"),
        F.coalesce(f"r_{f}", F.lit("UNKNOWN")).alias("observed_value"), status[f].alias("status")) for f in fields])))
    return rows.withColumn("severity", severity_of(F.col("field"), F.col("status")))


def diff_summary(diffs: DataFrame, key: str) -> DataFrame:
    """Counts per document, the identity and control subsets, and the overall severity."""
    bad = F.col("status") == "MISMATCH"
    out = diffs.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_fields"), F.count_if(F.col("status") == "MATCH").alias("matched_fields"),
        F.count_if(bad).alias("mismatched_fields"), F.count_if(F.col("status") == "UNKNOWN").alias("unknown_fields"),
        F.count_if(bad & F.col("field").isin(*IDENTITY_CRITICAL)).alias("identity_mismatches"),
        F.count_if(bad & F.col("field").isin(*DOCUMENT_CONTROL)).alias("control_mismatches"),
        F.max(bad & (F.col("severity") == "CRITICAL")).alias("_critical"))
    overall = (F.when((F.col("identity_mismatches") >= 2) | F.col("_critical"), "CRITICAL")
               .when(F.col("mismatched_fields") > 0, "HIGH")
               .when(F.col("unknown_fields") > F.floor(F.col("total_fields") / 2), "MEDIUM").otherwise("LOW"))
    label = F.format_string("Field Consistency: %d/%d matched", "matched_fields", "total_fields")
    return out.withColumns({"overall_severity": overall, "consistency_label": label}).drop("_critical")


def linkage(passports: DataFrame, visas: DataFrame, key: str, similarity: str | None = None) -> DataFrame:
    """Whether a passport and a visa belong together; similarity is a column of the visas, if there is one."""
    pairs = paired(passports, visas, key, LINKAGE_FIELDS, right_extra="holder_name", how="inner")
    if similarity:
        pairs = pairs.join(visas.select(key, F.col(similarity).alias("_sim")), key)
    else:
        pairs = pairs.withColumn("_sim", F.lit(None).cast("double"))
    pairs = pairs.withColumns({f"s_{f}": compare_status(f, F.col(f"l_{f}"), F.col(f"r_{f}")) for f in LINKAGE_FIELDS})

    def n(status):
        return sum((F.when(F.col(f"s_{f}") == status, 1).otherwise(0) for f in LINKAGE_FIELDS), F.lit(0))
    pairs = pairs.withColumns({"matched": n("MATCH"), "mismatched": n("MISMATCH"), "unknown": n("UNKNOWN")})
    number = F.col("s_passport_number")
    overall = (F.when((F.col("mismatched") == 0) & (F.col("matched") >= 3) & (number == "MATCH"), "MATCH")
               .when(F.col("mismatched") > 0, "MISMATCH").when(F.col("matched") >= 1, "PARTIAL_MATCH")
               .otherwise("UNABLE_TO_VERIFY"))
    face = (F.when(F.col("_sim").isNull(), "UNKNOWN").when(F.col("_sim") >= 0.65, "MATCH")
            .when(F.col("_sim") >= 0.50, "BORDERLINE").otherwise("MISMATCH"))
    return pairs.select(key, "matched", "mismatched", "unknown", (number == "MATCH").alias("number_linked"),
                        overall.alias("linkage_status"), face.alias("similarity_status"))


# -- visual reading against the machine-readable zone -------------------------------------

CANONICAL = ["document_type", "document_number", "surname", "given_names", "full_name", "nationality",
             "date_of_birth", "date_of_expiry", "sex"]


def cross_check(pairs: DataFrame, key: str, variant: str = "record", zone_applies: Column | None = None) -> DataFrame:
    """Status of each canonical field from columns v_<field> and z_<field>.

    'record' leaves out fields with no value; 'display' shows every field, hides labels
    and placeholders, and says NOT_APPLICABLE where a document has no zone.
    """
    if variant == "display":
        # shown values first, so that they are computed once
        pairs = pairs.select(key, *[usable(F.col(f"{side}_{f}"), f).alias(f"{side}_{f}") for f in CANONICAL for side in "vz"])
    entries = []
    for f in CANONICAL:
        v, z = F.col(f"v_{f}"), F.col(f"z_{f}")
        equal = (record_equal if variant == "record" else display_equal)(f, v, z)
        applies = F.lit(True) if zone_applies is None else zone_applies
        both = v.isNotNull() & z.isNotNull()
        status = F.when(both, F.when(equal, "MATCH").otherwise("MISMATCH")).when(z.isNotNull(), "MRZ_ONLY")
        if variant == "display":
            status = (status.when(v.isNotNull(), F.when(applies, "VIZ_ONLY").otherwise("NOT_APPLICABLE"))
                      .when(applies, "NOT_PRESENT").otherwise("NOT_APPLICABLE"))
        else:
            status = status.when(v.isNotNull(), "VIZ_ONLY")
        entries.append(F.struct(F.lit(f).alias("field"), v.alias("visual_value"), z.alias("zone_value"),
                                status.alias("status")))
    return pairs.select(key, F.inline(F.array(*entries))).filter("status is not null")


def resolved_fields(pairs: DataFrame, key: str) -> DataFrame:
    """Each canonical field by source priority: a validated zone, the visual reading, any zone;
    a missing full name is composed. Needs zone_valid besides v_ and z_ columns."""
    out = pairs.select(key, *[resolve(f, [F.when(F.col("zone_valid"), F.col(f"z_{f}")), F.col(f"v_{f}"),
                                          F.col(f"z_{f}")]).alias(f) for f in CANONICAL])
    composed = usable(full_name(F.col("given_names"), F.col("surname")), "full_name")
    return out.withColumn("full_name", F.coalesce("full_name", composed))


BACKFILLED = ["document_number", "surname", "given_names", "full_name", "nationality", "date_of_birth",
              "date_of_expiry", "sex"]


def backfilled(pairs: DataFrame, key: str) -> DataFrame:
    """Long form of the visual reading completed from a decoded zone (parsed)."""
    entries = []
    for f in BACKFILLED:
        b = backfill(f, F.col(f"v_{f}"), F.when(F.col("parsed"), F.col(f"z_{f}")))
        entries.append(F.struct(F.lit(f).alias("field"), b.alias("b")))
    return pairs.select(key, F.inline(F.array(*entries))).select(key, "field", "b.*")


# -- rules ------------------------------------------------------------------------------

def _rule(rule: str, severity: str, field: str, expected: Column, observed: Column, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"),
                                 F.lit(field).alias("field"), expected.alias("expected"), observed.alias("observed")))


def _emit(df: DataFrame, key: str, rules: list[Column]) -> DataFrame:
    return df.select(key, F.inline(F.array(*rules))).filter("rule_id is not null")


def zone_findings(pairs: DataFrame, key: str) -> DataFrame:
    """Disagreements of the visual reading with a parsed zone. An unreadable visual date is no finding."""
    def text(c):
        return F.nullif(F.trim(F.col(c)), F.lit(""))
    vn, zn = fold_number(text("v_document_number")), fold_number(text("z_document_number"))
    name_v = F.trim(F.replace(F.upper(text("v_full_name")), F.lit("."), F.lit(" ")))
    name_z = F.upper(text("z_full_name"))
    rules = [_rule("VIZ_MRZ_DOC_NUM_MATCH", "CRITICAL", "document_number", zn, vn, vn != zn)]
    for rule, severity, f in (("VIZ_MRZ_DOB_MATCH", "CRITICAL", "date_of_birth"),
                              ("VIZ_MRZ_EXPIRY_MATCH", "HIGH", "date_of_expiry")):
        v, z = text(f"v_{f}"), text(f"z_{f}")
        rules.append(_rule(rule, severity, f, z, v, strict_date(v) != z))
    rules.append(_rule("VIZ_MRZ_NAME_MATCH", "HIGH", "full_name", name_z, name_v,
                       (F.size(token_set(name_v)) > 0) & (F.size(token_set(name_z)) > 0)
                       & ~any_token_shared(name_v, name_z)))
    return _emit(pairs.filter("parsed"), key, rules)


def passport_findings(docs: DataFrame, watchlist: DataFrame, key: str, as_of: str) -> DataFrame:
    """Expired, listed, or not an identity page. ``docs`` has document_number, date_of_expiry,
    is_identity_page and page_type."""
    norm = F.left(F.coalesce(strict_date(F.col("date_of_expiry")), F.col("date_of_expiry")), F.lit(10))
    page = F.col("is_identity_page") & (F.col("page_type") != "PASSPORT_COVER")
    own = _emit(docs, key, [
        _rule("DOCUMENT_NOT_EXPIRED", "HIGH", "date_of_expiry", F.lit("Future Date"), norm, is_past(norm, as_of)),
        _rule("IDENTITY_PAGE_REQUIRED", "CRITICAL", "page_type", F.lit("PASSPORT_IDENTITY_PAGE"), F.col("page_type"),
              ~page)])
    listed = watchlist_hits(docs.select(key, F.col("document_number").alias("_n")), watchlist, "_n")
    flagged = F.concat(F.lit("FLAGGED ("), "risk_category", F.lit(")"))
    return own.unionByName(listed.select(
        key, F.lit("WATCHLIST_MATCH").alias("rule_id"), F.lit("CRITICAL").alias("severity"),
        F.lit("document_number").alias("field"), F.lit("CLEAR").alias("expected"), flagged.alias("observed")))


STAY_LIMIT_DAYS = 180


def visa_findings(visas: DataFrame, key: str, as_of: str, presented: str | None = None) -> DataFrame:
    """Number syntax, expiry, date order, length of stay and the passport it names."""
    number = F.nullif(F.col("visa_number"), F.lit(""))
    shape = "Standard Alphanumeric Identifier (6-12 chars)"
    until, start = visa_date(F.col("valid_until")), visa_date(F.col("valid_from"))
    days = F.regexp_extract(F.col("stay_duration"), r"(\d+)\s*DAY", 1).try_cast("bigint")
    kind = F.coalesce(F.nullif(F.col("visa_type"), F.lit("")), F.lit("TOURIST"))
    df = visas.withColumns({"_until": until, "_from": start, "_days": days, "_kind": kind})
    rules = [
        _rule("VISA_NUMBER_FORMAT", "HIGH", "visa_number", F.lit(shape), F.coalesce(number, F.lit("NOT_FOUND")),
              number.isNull() | (F.length(number) < 6) | ~number.rlike("^[A-Z0-9]+$")),
        _rule("VISA_EXPIRY_CHECK", "CRITICAL", "valid_until", F.lit("Future Date"), F.col("_until"),
              is_past(F.col("_until"), as_of)),
        _rule("VISA_DATE_RANGE_INVALID", "CRITICAL", "valid_from", F.lit("Valid From <= Valid Until"),
              F.format_string("From: %s > Until: %s", "_from", "_until"), F.col("_from") > F.col("_until")),
        _rule("VISA_STAY_DURATION", "MEDIUM", "stay_duration", F.lit("<= 180 Days for declared category"),
              F.format_string("%d Days (%s)", "_days", "_kind"),
              F.col("_kind").isin("TOURIST", "TRANSIT") & (F.col("_days") > STAY_LIMIT_DAYS)),
    ]
    if presented:
        named, shown = fold_number(F.col("passport_number")), fold_number(F.col(presented))
        rules.append(_rule("VISA_PASSPORT_CROSS_CHECK", "CRITICAL", "passport_number", shown, named, named != shown))
    return _emit(df, key, rules)
