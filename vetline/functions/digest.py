"""Digests, canonical payloads and lineage text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = "0" * 64
PIPELINE_VERSION = "1.0.0"


def sha256_hex(c: Column) -> Column:
    """Lower-case hex digest; null for empty input, which has no digest here."""
    return F.when(F.length(c) > 0, F.sha2(c, 256))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON text with keys in sorted order, the form every digest is taken over."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def json_digest(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def canonical_payload(case_id: Column, document_hash: Column, band: Column, station: Column,
                      version: str = PIPELINE_VERSION) -> Column:
    return F.concat_ws("|", F.trim(case_id), F.lower(F.trim(document_hash)), F.upper(F.trim(band)),
                       F.trim(station), F.lit(version))


def is_digest(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def utc_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def lineage(parent: Column, child: Column, role: Column) -> Column:
    return F.format_string("%s -> %s (%s)", parent, child, role)
