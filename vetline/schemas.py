"""Fixed schemas of the stored tables and files, and additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType(), "double": T.DoubleType(),
          "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _schema(text: str, **nested: T.DataType) -> T.StructType:
    """A schema from 'name type, ...'; nested types are given by name."""
    flat = [T.StructField(n, _TYPES[t]) for n, t in (part.split() for part in text.split(","))]
    return T.StructType(flat + [T.StructField(n, t) for n, t in nested.items()])


TABLES = {
    "users": _schema("id int, username string, email string, role string, full_name string, badge_number string, "
                     "checkpoint_id string, checkpoint_name string, location string, is_active boolean, "
                     "created_at timestamp"),
    "checkpoints": _schema("id string, code string, name string, location string, username string, role string, "
                           "is_active boolean, created_at timestamp"),
    "screenings": _schema("id string, created_at timestamp, operator_id int, checkpoint_id string, "
                          "checkpoint_name string, document_type string, masked_document_id string, status string, "
                          "risk_score double, risk_band string, recommendation string, doc_image_path string, "
                          "live_image_path string, ela_heatmap_path string, ocr_engine string, "
                          "execution_latency_ms double"),
    "extracted_fields": _schema("id int, screening_id string, field_name string, visual_value string, "
                                "mrz_value string, confidence double, ocr_engine string, validation string, "
                                "match_status string, bounding_box_json string"),
    "validation_findings": _schema("id int, screening_id string, rule_id string, category string, severity string, "
                                   "field string, expected string, observed string, message string, "
                                   "classification string"),
    "tamper_findings": _schema("id int, screening_id string, technique string, severity string, score double, "
                               "summary string, observation string, interpretation string"),
    "face_results": _schema("id int, screening_id string, metric string, similarity_score double, threshold double, "
                            "verification_result string, appearance_level string, observations_json string, "
                            "recommendation string, provider string, quality_status string, pad_status string, "
                            "pad_reason string"),
    "identity_matches": _schema("id int, screening_id string, matched_document_id string, matched_name string, "
                                "similarity double, alert_message string"),
    "audit_events": _schema("id int, screening_id string, timestamp timestamp, actor string, event_type string, "
                            "payload_hash string, previous_hash string, event_hash string"),
    "blockchain_anchors": _schema("id int, screening_id string, document_hash string, result_hash string, "
                                  "transaction_id string, ledger_asset_id string, anchor_timestamp timestamp, "
                                  "network string, channel string, chaincode string, status string, "
                                  "verification_timestamp timestamp, verification_message string, "
                                  "created_at timestamp"),
    "reference_watchlist": _schema("id int, document_id string, full_name string, nationality string, reason string, "
                                   "risk_category string, status string, classification string, created_at timestamp"),
}

# Values given to a column that older rows lack.
DEFAULTS = {
    "validation": "VALID", "quality_status": "GOOD", "pad_status": "NOT_AVAILABLE", "match_status": "MATCH",
    "appearance_level": "MINIMAL", "status": "ACTIVE", "role": "OFFICER",
}

MANIFEST = _schema("case_id string, image_id string, document_type string, category string, expected_risk string, "
                   "tamper_type string, doc_path string, selfie_path string, description string")

RECORDS = _schema("version string, created_at string, total_records int", records=T.ArrayType(_schema(
    "internal_id string, person_id string, document_type string, evaluation_role string, source_file_name string, "
    "sha256_hash string, source_image_hash string, is_collage boolean, has_face boolean, has_mrz boolean, "
    "demo_marking_visible boolean", field_availability=T.MapType(T.StringType(), T.StringType()))))

RULES = _schema("document_type string, version string, authority string", rules=T.ArrayType(_schema(
    "rule_id string, name string, category string, severity string, classification string, standard_ref string, "
    "description string")))


def evolve(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """The frame with all columns of ``schema``: missing ones get their default, or null."""
    defaults = DEFAULTS if defaults is None else defaults
    have = set(df.columns)
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in have else
                       F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields], *extra)
