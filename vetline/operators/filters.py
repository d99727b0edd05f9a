"""Selections and row-level rules: scoping, access, permissions, admission of identifiers, status changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline.functions.text import strip_identifier, words
from vetline.operators.ordered import with_lag

# Fixed values.
CASE_STATUSES = ["CLEARED", "MANUAL_REVIEW_REQUIRED", "ESCALATED", "SUSPENDED"]
REVIEW_STATUSES = ["MANUAL_REVIEW_REQUIRED", "MANUAL_REVIEW"]
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
OFFICER_PERMISSIONS = ["screening:create", "screening:view", "media:access", "report:download", "audit:view",
                       "audit:verify", "blockchain:anchor", "blockchain:verify", "watchlist:view", "analytics:view"]
SUPERVISOR_EXTRA = ["case:review", "watchlist:manage"]
ADMIN_EXTRA = ["system:admin"]
SENSITIVE_NAME_PARTS = ["name", "fullname", "firstname", "lastname", "dob", "dateofbirth", "passportnumber",
                        "visanumber", "docnumber", "documentnumber", "nationality", "address", "photo", "image",
                        "selfie", "embedding", "descriptor", "facecrop", "rawtext", "ocrtext", "ocrlines",
                        "biometricvector"]
LONG_VALUE_ALLOWED = ("canonical_payload", "verification_message")
MAX_VALUE_LENGTH = 256


def by_id(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.col(column) == F.lit(value))


def with_status(df: DataFrame, statuses: list[str], column: str = "status") -> DataFrame:
    return df.filter(F.col(column).isin(*statuses))


def active(df: DataFrame) -> DataFrame:
    return df.filter("is_active")


def effective_role(role: Column) -> Column:
    """Upper-cased role; missing counts as OFFICER."""
    return F.upper(F.coalesce(F.nullif(role, F.lit("")), F.lit("OFFICER")))


def station(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def scope_for(df: DataFrame, role: str | None, station_id: str | None) -> DataFrame:
    """Rows one viewer may list: officers with a station see that station, everybody else all."""
    if (role or "OFFICER").upper() == "OFFICER" and station_id and station_id.strip():
        return df.filter(F.col("checkpoint_id") == station_id.strip())
    return df


def visible_counts(df: DataFrame, users: DataFrame) -> DataFrame:
    """How many rows each user may list. Stations are counted once and looked up, never
    paired row by row."""
    per_station = df.groupBy("checkpoint_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed(
        "checkpoint_id", "_station")
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    bound = (effective_role(F.col("role")) == "OFFICER") & station(F.col("checkpoint_id")).isNotNull()
    return users.withColumn("_own", F.when(bound, station(F.col("checkpoint_id")))).join(
        per_station, F.col("_own") == F.col("_station"), "left").select(
        F.col("id").alias("user_id"), F.when(bound, F.coalesce("n", F.lit(0))).otherwise(total).alias("visible"))


def access_decisions(requests: DataFrame, users: DataFrame, screenings: DataFrame) -> DataFrame:
    """Denied (user, screening) requests as event rows. Officers are bound to their station
    when both stations are known."""
    u = users.select(F.col("id").alias("user_id"), "username", effective_role(F.col("role")).alias("role"),
                     station(F.col("checkpoint_id")).alias("user_station"))
    s = screenings.select(F.col("id").alias("screening_id"), station(F.col("checkpoint_id")).alias("row_station"))
    denied = ~F.col("role").isin("SUPERVISOR", "ADMIN") & (F.col("user_station") != F.col("row_station"))
    return (requests.join(u, "user_id").join(s, "screening_id").filter(denied)
            .select("user_id", "screening_id", F.lit("ACCESS_DENIED").alias("event_type"),
                    F.concat_ws(":", "role", "username").alias("actor"), "user_station", "row_station"))


def permissions(users: DataFrame) -> DataFrame:
    """One row per user and granted permission; unknown roles get the officer set."""
    supervisor = OFFICER_PERMISSIONS + SUPERVISOR_EXTRA
    role = effective_role(F.col("role"))
    granted = (F.when(role == "ADMIN", words(supervisor + ADMIN_EXTRA)).when(role == "SUPERVISOR", words(supervisor))
               .otherwise(words(OFFICER_PERMISSIONS)))
    return users.select(F.col("id").alias("user_id"), F.explode(granted).alias("permission"))


def search(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    hit = [F.lower(F.col(c)).contains(term.lower()) for c in columns]
    return df.filter(reduce(lambda a, b: a | b, hit))


def in_domain(c: Column, domain: list[str]) -> Column:
    return F.coalesce(c.isin(*domain), F.lit(False))


def quarantine(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a check, and those that do not (unknown counts as not)."""
    passed = F.coalesce(ok, F.lit(False))
    return df.filter(passed), df.filter(~passed)


def clean_watchlist(df: DataFrame) -> DataFrame:
    """Entries as stored: stripped identifier, trimmed, upper-cased and cut texts. Rows whose
    identifier has no legal character are dropped, as their entry is refused; of several entries of one
    identifier the first in order of the other columns stays, as a known identifier is refused."""
    def upper_cut(c, n):
        return F.left(F.upper(F.trim(F.col(c))), F.lit(n))
    out = df.select(strip_identifier(F.col("document_id")).alias("document_id"),
                    upper_cut("full_name", 100).alias("full_name"), upper_cut("nationality", 10).alias("nationality"),
                    F.left(F.trim("reason"), F.lit(500)).alias("reason"),
                    upper_cut("risk_category", 30).alias("risk_category"), upper_cut("status", 20).alias("status"))
    rest = [c for c in out.columns if c != "document_id"]
    return out.filter(F.col("document_id") != "").groupBy("document_id").agg(F.min(F.struct(*rest)).alias("e")).select("document_id", "e.*")


def sensitive_columns(df: DataFrame) -> list[str]:
    """Columns whose name holds a banned part."""
    def folded(c):
        return c.lower().replace("_", "").replace("-", "")
    return [c for c in df.columns if any(p in folded(c) for p in SENSITIVE_NAME_PARTS)]


def minimised_report(df: DataFrame) -> DataFrame:
    """Per text column: banned name, and how many values are too long for a digest or code."""
    banned = set(sensitive_columns(df))
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    counts = df.agg(*[F.count_if(F.length(F.col(c)) > MAX_VALUE_LENGTH).alias(c) for c in text])
    entries = [F.struct(F.lit(c).alias("column_name"), F.lit(c in banned).alias("banned_name"),
                        (F.lit(0) if c in LONG_VALUE_ALLOWED else F.col(c)).cast("bigint").alias("too_long"))
               for c in text]
    return counts.select(F.inline(F.array(*entries)))


def assert_minimised(df: DataFrame) -> DataFrame:
    """The frame itself, or an error naming the offending column."""
    banned = sensitive_columns(df)
    if banned:
        raise ValueError(f"sensitive column {banned[0]!r}")
    row = minimised_report(df).filter("too_long > 0").first()
    if row:
        raise ValueError(f"column {row['column_name']!r} holds values over {MAX_VALUE_LENGTH} characters")
    return df


def confident_tokens(df: DataFrame, minimum: float = 15.0) -> DataFrame:
    return df.filter((F.trim("text") != "") & (F.col("conf") > minimum))


def apply_status(screenings: DataFrame, updates: DataFrame, position: str = "seq") -> DataFrame:
    """One row per update with the status before and after, in the order of ``position``: an update starts from
    where the one before it ended. A case without updates has one row; updates outside the domain are ignored."""
    new = F.upper(F.trim("status"))
    clean = updates.filter(in_domain(new, CASE_STATUSES)).select("case_id", position, new.alias("new_status"))
    chained = with_lag(clean, ["case_id"], position, ["new_status"])
    return screenings.join(chained, screenings["id"] == chained["case_id"], "left").select(
        screenings["id"], F.col(position), F.coalesce("prev_new_status", "status").alias("old_status"),
        F.coalesce("new_status", "status").alias("new_status"), F.col("case_id").isNotNull().alias("changed"))
