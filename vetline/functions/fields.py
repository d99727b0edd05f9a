"""Field-level rules: aliases, equality of two readings, severity, priority of sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vetline.functions.dates import display_date, normalize_date, strict_date
from vetline.functions.text import (
    DEMONYMS, SEX_CODES, full_name, is_label_noise, let, let_sql, lookup, normalize_text, same_tokens, shown_text,
    token_overlap)

# Names a field goes by, in the order they are tried.
ALIASES = {
    "document_type": ["document_type", "doc_type", "type", "visa_type"],
    "document_number": ["document_number", "passport_number", "visa_number", "doc_number"],
    "surname": ["surname", "last_name"],
    "given_names": ["given_names", "first_name", "names"],
    "full_name": ["full_name", "holder_name", "name"],
    "nationality": ["nationality", "issuing_country", "country"],
    "date_of_birth": ["date_of_birth", "dob", "birth_date"],
    "date_of_expiry": ["date_of_expiry", "valid_until", "expiry", "expiry_date", "expiration_date"],
    "sex": ["sex", "gender"],
}
PASSPORT_FIELDS = ["name", "date_of_birth", "sex", "nationality", "passport_number", "date_of_expiry"]
VISA_FIELDS = ["visa_number", "passport_number", "name", "date_of_birth", "sex", "nationality", "visa_type",
               "valid_from", "valid_until", "entries", "duration_of_stay"]
LINKAGE_FIELDS = ["passport_number", "name", "date_of_birth", "nationality", "sex"]
IDENTITY_CRITICAL = ["name", "date_of_birth", "nationality", "sex", "passport_number", "visa_number"]
DOCUMENT_CONTROL = ["date_of_expiry", "valid_until", "valid_from", "entries", "duration_of_stay", "visa_type"]
DATE_HINTS = ["birth", "dob", "expiry", "valid_from", "valid_until", "issue"]


def is_date_field(field: str) -> bool:
    return any(h in field for h in DATE_HINTS)


def canonical(columns: list[str], name: str) -> Column:
    """First present alias of a canonical field."""
    present = [F.nullif(F.col(a), F.lit("")) for a in ALIASES[name] if a in columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def normalised(field: str, value: Column) -> Column:
    return normalize_date(value) if is_date_field(field) else normalize_text(value)


def names_equal(a: Column, b: Column) -> Column:
    """Same words in any order."""
    wa, wb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return (F.size(F.array_except(wa, wb)) == 0) & (F.size(F.array_except(wb, wa)) == 0)


def compare_status(field: str, a: Column, b: Column) -> Column:
    """MATCH, MISMATCH or UNKNOWN of two normalised values of a field."""
    same = a == b
    if "name" in field:
        same = same | names_equal(a, b)
    if "nationality" in field:
        same = same | F.coalesce(lookup(DEMONYMS, a) == lookup(DEMONYMS, b), F.lit(False))
    if "sex" in field:
        same = same | F.coalesce(lookup(SEX_CODES, a) == lookup(SEX_CODES, b), F.lit(False))
    return F.when(a.isNull() | b.isNull(), "UNKNOWN").when(same, "MATCH").otherwise("MISMATCH")


def severity_of(field: Column, status: Column) -> Column:
    """Severity of a mismatch by field; LOW for anything else."""
    return (F.when(status != "MISMATCH", "LOW")
            .when(field.isin("passport_number", "document_number", "visa_number"), "CRITICAL")
            .when(field.isin("name", "full_name", "date_of_birth", "dob", "nationality", "sex", "date_of_expiry",
                             "valid_until", "valid_from"), "HIGH").otherwise("MEDIUM"))


def record_equal(field: str, visual: Column, zone: Column) -> Column:
    """Equality used when a result is stored; both sides present."""
    v, z = F.upper(F.trim(visual)), F.upper(F.trim(zone))
    same = v == z
    if field in ("date_of_birth", "date_of_expiry"):
        same = same | (F.coalesce(strict_date(v), v) == F.coalesce(strict_date(z), z))
    elif field == "nationality":
        same = same | (v.isin("INDIAN", "IND") & z.isin("INDIAN", "IND")) | v.startswith(z) | z.startswith(v)
    elif field == "sex":
        same = same | (lookup(SEX_CODES, v) == lookup(SEX_CODES, z))
    elif field == "full_name":
        same = same | same_tokens(v, z) | (token_overlap(v, z) >= 0.7)
    elif field == "document_number":
        same = same | (F.regexp_replace(v, "[^A-Z0-9]", "") == F.regexp_replace(z, "[^A-Z0-9]", ""))
    elif field == "document_type":
        same = same | (v.isin("PASSPORT", "P") & z.isin("PASSPORT", "P"))
    return F.coalesce(same, F.lit(False))


def display_equal(field: str, visual: Column, zone: Column) -> Column:
    """Equality used in the report view: dates by calendar, names by overlap, prefixes count."""
    v = F.upper(F.regexp_replace(visual, "[^A-Za-z0-9]", ""))
    z = F.upper(F.regexp_replace(zone, "[^A-Za-z0-9]", ""))
    same = (v == z) | v.startswith(z) | z.startswith(v)
    if field == "document_type":
        same = same | (v.isin("PASSPORT", "P") & z.isin("PASSPORT", "P")) | (v.isin("VISA", "V") & z.isin("VISA", "V"))
    if field in ("sex", "gender"):
        same = same | F.coalesce(lookup(SEX_CODES, v) == lookup(SEX_CODES, z), F.lit(False))
    if field in ("full_name", "name"):
        wv, wz = (F.filter(F.split(F.upper(c), "[^A-Z]+"), lambda w: F.length(w) > 1) for c in (visual, zone))
        hits = F.size(F.filter(wv, lambda w: F.array_contains(wz, w)))
        larger = F.greatest(F.size(F.array_distinct(wv)), F.size(F.array_distinct(wz)))
        same = same | ((F.size(wv) > 0) & (F.size(wz) > 0) & (hits / F.greatest(larger, F.lit(1)) >= 0.7))
    if "date" in field or field in ("dob", "expiry"):
        plain = same
        same = let(F.transform(F.array(visual, zone), display_date), lambda d: F.when(
            d[0].isNotNull() & d[1].isNotNull(), d[0] == d[1]).otherwise(plain))
    return F.coalesce(same, F.lit(False))


def usable(c: Column, field: str) -> Column:
    """The value a display would show, null for placeholders and labels."""
    return let_sql(c, shown_text(field))


def resolve(field: str, sources: list[Column]) -> Column:
    """First usable value in priority order."""
    return F.coalesce(*[usable(c, field) for c in sources])


def backfill(field: str, visual: Column, zone: Column) -> Column:
    """Visual reading, or the zone's when the reading is missing; name readings are also
    replaced when they are labels or too short. Returns value, source and confidence flag."""
    weak = F.coalesce(visual, F.lit("")) == ""
    if field in ("surname", "given_names", "full_name"):
        shortest = 4 if field == "full_name" else 2
        weak = weak | is_label_noise(visual, "reader") | (F.length(visual) <= shortest)
    value = zone
    if field == "nationality":
        value = F.when(zone == "IND", "INDIAN").otherwise(zone)
    if field == "sex":
        value = F.when(zone != "UNSPECIFIED", zone)
    take = weak & (F.coalesce(value, F.lit("")) != "")
    return F.struct(F.when(take, value).otherwise(F.nullif(visual, F.lit(""))).alias("value"),
                    F.when(take, "MRZ_VERIFIED").when(F.coalesce(visual, F.lit("")) != "", "VIZ").alias("source"),
                    F.when(take, F.lit(0.99)).alias("confidence"))


def record_name(columns: list[str], extra: str | None = None) -> Column:
    """'name', else given names and surname, else a given fallback column."""
    options = [F.col("name")] if "name" in columns else []
    if "surname" in columns and "given_names" in columns:
        options.append(full_name(F.col("given_names"), F.col("surname")))
    if extra and extra in columns:
        options.append(F.col(extra))
    return F.coalesce(*options)
