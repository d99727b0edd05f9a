"""Whole-table decisions: statuses, gates, quality, similarity bands, forensics and risk fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline.functions.numeric import clamp, fixed_round, quality_points, weighted_score
from vetline.operators.ordered import SLICE_ROWS, with_rank
from vetline.operators.topk import severity_rank, top_per_group
from vetline.session import stored

# Fixed values of the scoring.
WEIGHTS = {"mrz": 0.22, "viz": 0.25, "tamper": 0.20, "face": 0.18, "rules": 0.10, "quality": 0.05, "reuse": 0.20}
TAMPER_WEIGHTS = {"ela": 0.35, "noise": 0.25, "copy_move": 0.20, "edge": 0.15, "metadata": 0.05}
EDITORS = ["adobe", "photoshop", "gimp", "canva", "procreate", "pixelmator", "affinity", "paint.net", "corel",
           "lightroom"]
# Fixed values of the outcome.
BAND_ADVICE = {
    "LOW": "Routine Clearance Permitted. Document passes automated integrity checks.",
    "MEDIUM": "Additional Verification Recommended. Minor inconsistencies require routine officer review.",
    "HIGH": "Manual Secondary Verification Required. Significant discrepancies or tampering indicators observed.",
    "CRITICAL": "Escalated Supervisor Intervention Required. Multiple critical integrity or biometric failures detected.",
}
COVER_ADVICE = ("Identity Page Not Detected — recapture required. Upload the passport biodata/identity page containing portrait and "
                "machine-readable information.")
QUALITY_ADVICE = "Unable to verify — image quality is insufficient. Please capture a clearer document."
COVER_FLOOR = 75.0


def reader_status(populated: Column, has_zone: Column) -> Column:
    """Reader variant: fields and zone lines found."""
    return F.when((populated >= 3) & has_zone, "SUCCESS").when((populated >= 1) | has_zone, "PARTIAL").otherwise("FAILED")


def visa_status(core: Column, total: Column) -> Column:
    return F.when(core >= 2, "SUCCESS").when(total >= 1, "PARTIAL").otherwise("FAILED")


def reread_status(meaningful: Column, is_identity_page: Column) -> Column:
    return (F.when(~is_identity_page, F.when(meaningful >= 1, "PARTIAL").otherwise("FAILED"))
            .when(meaningful >= 2, "SUCCESS").when(meaningful == 1, "PARTIAL").otherwise("FAILED"))


def band(score: Column) -> Column:
    return F.when(score < 30, "LOW").when(score < 60, "MEDIUM").when(score < 80, "HIGH").otherwise("CRITICAL")


def terminal_status(is_identity_page: Column, quality_verdict: Column, risk_band: Column) -> Column:
    return (F.when(~is_identity_page, "MANUAL_REVIEW_REQUIRED")
            .when(quality_verdict.isin("REJECTED", "NEEDS_BETTER_IMAGE"), "UNABLE_TO_VERIFY")
            .when(risk_band == "LOW", "COMPLETED").otherwise("MANUAL_REVIEW_REQUIRED"))


def gate(failed: Column, quality_verdict: Column, supported: Column) -> Column:
    """What stops a case before scoring: status, score and band; null when it may go on."""
    def stop(status, score, level):
        return F.struct(F.lit(status).alias("status"), F.lit(score).alias("risk_score"), F.lit(level).alias("risk_band"))
    return (F.when(failed, stop("FAILED", 75.0, "HIGH"))
            .when(quality_verdict.isin("REJECTED", "NEEDS_BETTER_IMAGE"), stop("QUALITY_REJECTED", 60.0, "MEDIUM"))
            .when(~supported, stop("UNSUPPORTED_DOCUMENT", 80.0, "HIGH")))


# -- quality -----------------------------------------------------------------------

def capture_quality(m: DataFrame) -> DataFrame:
    """Verdict, score and reasons over blur, glare, contrast, brightness, width, height."""
    w, h = F.col("width"), F.col("height")
    low, high = F.least(w, h), F.greatest(w, h)
    sized = ((w >= 640) & (h >= 480)) | ((high >= 640) & (low >= 200)) | ((low >= 200) & (high >= 480)) | (
        w * h >= 120000)
    reasons = F.array_compact(F.array(
        F.when(F.col("blur") < 50, "BLUR"), F.when(F.col("glare") > 0.25, "GLARE"),
        F.when(F.col("contrast") < 18, "CONTRAST"),
        F.when(F.col("brightness") < 25, "DARK").when(F.col("brightness") > 245, "WASHED_OUT"),
        F.when(~sized, "RESOLUTION")))
    out = m.withColumns({"reasons": reasons, "overall_score": quality_points(
        F.col("blur"), F.col("glare"), F.col("contrast"), F.col("brightness"))})
    return out.withColumn("verdict", F.when((F.size("reasons") == 0) & (F.col("overall_score") >= 50), "GOOD").otherwise(
        "NEEDS_BETTER_IMAGE"))


def crop_quality(m: DataFrame) -> DataFrame:
    """GOOD, ACCEPTABLE or POOR for a portrait crop."""
    w, h, blur, light, contrast = (F.col(c) for c in ("width", "height", "blur", "brightness", "contrast"))
    poor = (((F.col("face_count") > 1) & ~F.col("is_document")) | (w < 50) | (h < 50) | (blur < 25)
            | (light < 35) | (light > 225) | (contrast < 18))
    fair = (w < 80) | (h < 80) | (blur < 60) | (light < 60) | (light > 200) | (contrast < 30)
    return m.withColumn("status", F.when(F.col("face_count") == 0, "UNABLE_TO_VERIFY").when(poor, "POOR").when(
        fair, "ACCEPTABLE").otherwise("GOOD"))


def appearance_level(hair_diff: Column, eye_density_diff: Column, light_diff: Column) -> Column:
    flags = sum((F.when(c, 1).otherwise(0) for c in (hair_diff > 45, eye_density_diff > 0.08, light_diff > 35)), F.lit(0))
    return F.when(flags == 0, "MINIMAL").when(flags == 1, "MODERATE").otherwise("SIGNIFICANT")


# -- similarity policies --------------------------------------------------------------

POLICIES = [  # name, match at, borderline at, may declare a match
    ("sface", 0.68, 0.48, True), ("gabor_lbp", 0.65, 0.50, False),
    ("linkage", 0.65, 0.50, True), ("matrix", 0.75, 0.50, True),
]


def similarity_band(rows: DataFrame, similarity: str, policy: str) -> DataFrame:
    """Outcome of a similarity under the policy named in a column. The policy table is fixed
    and tiny, so it is part of the expression."""
    c, p = F.col(similarity), F.col(policy)
    out = F.lit(None).cast("string")
    for name, match, borderline, discriminative in POLICIES:
        verdict = F.when(c < borderline, "MISMATCH").when(F.lit(discriminative) & (c >= match), "MATCH").otherwise("BORDERLINE")
        out = F.when(p == name, verdict).otherwise(out)
    return rows.withColumn("outcome", F.when(c.isNull(), "UNKNOWN").otherwise(out))


# -- forensics ----------------------------------------------------------------------

def edited_with(software: Column) -> Column:
    pattern = "|".join(e.replace(".", r"\.") for e in EDITORS)
    return F.coalesce(F.lower(software).rlike(pattern), F.lit(False))


def forensic_fusion(scores: DataFrame) -> DataFrame:
    """Composite of the five technique scores, verdict, and the techniques that become findings."""
    composite = weighted_score([(F.col(n), w) for n, w in TAMPER_WEIGHTS.items()])
    graded = lambda n: F.when(F.col(n) >= 65, "HIGH").otherwise("MEDIUM")

    def finding(technique, score, severity, when):
        return F.when(when, F.struct(F.lit(technique).alias("technique"), severity.alias("severity"),
                                     F.col(score).alias("score")))
    at40 = lambda n: F.col(n) >= 40
    findings = F.array_compact(F.array(
        finding("ELA", "ela", graded("ela"), at40("ela")),
        finding("NOISE_RESIDUAL", "noise", graded("noise"), at40("noise")),
        finding("COPY_MOVE", "copy_move", F.lit("HIGH"), at40("copy_move")),
        finding("EDGE_BOUNDARY", "edge", F.lit("MEDIUM"), at40("edge")),
        finding("METADATA", "metadata", F.lit("HIGH"), F.col("software_flag"))))
    out = scores.withColumns({"composite": composite, "findings": findings})
    return out.withColumn("verdict", F.when(F.col("composite") >= 40, "FORENSIC_ANOMALIES_DETECTED").otherwise(
        "NO_SIGNIFICANT_TAMPERING_DETECTED"))


# -- risk ---------------------------------------------------------------------------

def viz_points(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", 75.0).when(severity == "HIGH", 45.0).otherwise(20.0)


def rule_points(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", 85.0).when(severity == "HIGH", 55.0).otherwise(25.0)


def face_points(state: Column) -> Column:
    s = F.upper(state)
    return (F.when(s.isin("VERIFIED_MISMATCH", "VERIFIED MISMATCH", "MISMATCH"), 85.0)
            .when(s.isin("INCONCLUSIVE", "BORDERLINE"), 35.0).when(s.isin("INPUT_FAILURE", "UNABLE_TO_VERIFY"), 30.0)
            .when(s.isin("VERIFIED_MATCH", "VERIFIED MATCH", "MATCH"), 5.0).otherwise(0.0))


def mrz_points(parsed: Column, failed_checks: Column, doc_type: Column) -> Column:
    return (F.when(parsed & (failed_checks > 0), 40.0 + F.least(failed_checks * 20.0, F.lit(60.0)))
            .when(parsed, 0.0).when(doc_type == "PASSPORT", 25.0).otherwise(0.0))


def max_points(findings: DataFrame, case: str, points: Column, name: str) -> DataFrame:
    """Greatest severity points over the findings of a case."""
    return findings.groupBy(case).agg(F.max(points).alias(name))


def severe_categories(findings: DataFrame, case: str) -> DataFrame:
    """How many categories of a case hold a HIGH or CRITICAL finding, and what that adds. Rows are
    first cut to one per case and category."""
    severe = findings.groupBy(case, "category").agg(F.max(_is_severe(F.col("severity"))).alias("_s"))
    out = severe.groupBy(case).agg(F.count_if("_s").alias("severe_categories"))
    return out.withColumn("escalation", escalation(F.col("severe_categories")))


def escalation(severe_categories: Column) -> Column:
    return F.when(severe_categories >= 3, 25.0).when(severe_categories >= 2, 15.0).otherwise(0.0)


def _is_severe(c: Column) -> Column:
    return c.isin("CRITICAL", "HIGH")


def risk(cases: DataFrame, findings: DataFrame, tamper: DataFrame) -> DataFrame:
    """Fused risk per case.

    ``cases`` has id, document_type, parsed, failed_checks, composite_failed, tamper_score, face_state, duplicate,
    quality_verdict; the finding tables have screening_id and severity, ``findings`` also is_zone, which tells
    comparisons of the two zones from rules.
    """
    def tagged(rows, kind):
        return rows.select(F.col("screening_id").alias("id"), kind.alias("_kind"), "severity")

    def most(kind, value):
        return F.max(F.when(F.col("_kind") == kind, value))
    severity = F.col("severity")
    # all findings are cut to one row per case in one aggregate, so one narrow shuffle and one join
    marks = tagged(findings, F.when(F.col("is_zone"), "viz").otherwise("rules")).unionByName(
        tagged(tamper, F.lit("tamper"))).groupBy("id").agg(
        most("viz", viz_points(severity)).alias("viz"), most("rules", rule_points(severity)).alias("rules"),
        *[most(k, _is_severe(severity)).alias(f"{k}_severe") for k in ("viz", "rules", "tamper")])
    df = cases.join(marks, "id", "left")
    no, zero = F.lit(False), F.lit(0.0)
    df = df.withColumns({
        "mrz": mrz_points(F.col("parsed"), F.col("failed_checks"), F.col("document_type")),
        "viz": F.coalesce("viz", zero), "rules": F.coalesce("rules", zero),
        "tamper": F.coalesce("tamper_score", zero), "face": face_points(F.col("face_state")),
        "reuse": F.when(F.col("duplicate"), 90.0).otherwise(0.0),
        "quality": F.when(F.col("quality_verdict") == "NEEDS_BETTER_IMAGE", 60.0).otherwise(0.0),
    })
    severe = [
        F.col("parsed") & (F.col("failed_checks") > 0), F.coalesce("viz_severe", no),
        (F.col("tamper") >= 35) & F.coalesce("tamper_severe", no), F.col("face") == 85, F.col("reuse") > 0,
        F.coalesce("rules_severe", no)]
    df = df.withColumn("severe_categories", sum((F.when(F.coalesce(c, no), 1).otherwise(0) for c in severe), F.lit(0)))
    total = sum((F.col(n) * w for n, w in WEIGHTS.items()), escalation(F.col("severe_categories")))
    df = df.withColumn("risk_score", fixed_round(clamp(total), 1))
    return df.withColumn("risk_band", band(F.col("risk_score"))).select(
        "id", *WEIGHTS, "severe_categories", "risk_score", "risk_band")


def outcomes(scored: DataFrame) -> DataFrame:
    """``scored`` (risk_score, risk_band, is_identity_page, quality_verdict) with status and recommendation;
    a page that is not an identity page has at least the score of COVER_FLOOR and the band HIGH."""
    identity, poor = F.col("is_identity_page"), F.col("quality_verdict").isin("REJECTED", "NEEDS_BETTER_IMAGE")
    status = terminal_status(identity, F.col("quality_verdict"), F.col("risk_band"))
    advice = F.when(~identity, COVER_ADVICE).when(poor, QUALITY_ADVICE).otherwise(recommendation(F.col("risk_band")))
    return scored.withColumns({
        "status": status, "recommendation": advice,
        "risk_score": F.when(identity, F.col("risk_score")).otherwise(F.greatest("risk_score", F.lit(COVER_FLOOR))),
        "risk_band": F.when(identity, F.col("risk_band")).otherwise("HIGH")})


def recommendation(risk_band: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, advice in BAND_ADVICE.items():
        out = F.when(risk_band == name, advice).otherwise(out)
    return out


def risk_reasons(cases: DataFrame, findings: DataFrame, tamper: DataFrame) -> DataFrame:
    """One row per contributing reason with its points and its place of insertion.

    ``step`` is the place of the signal and ``seq`` the place of the finding inside it. ``cases`` has the columns
    of ``risk`` and appearance_level, is_identity_page and failed_names, the names of the failed checks. Cases and
    findings are each read once; the share of a forensic finding needs the number of findings of its case, which
    comes, with the case's score, from one aggregate.
    """
    first, face, mrz = F.lit(0), F.col("f"), F.col("m")
    c = cases.withColumns({"m": mrz_points(F.col("parsed"), F.col("failed_checks"), F.col("document_type")),
                           "f": face_points(F.col("face_state"))})

    def reason(when, step, category, severity, points, summary, seq=first):
        points = F.lit(None).cast("double") if points is None else fixed_round(points, 1)
        row = F.struct(step.alias("step"), seq.cast("bigint").alias("seq"), category.alias("category"),
                       severity.alias("severity"), points.alias("points"), summary.alias("summary"))
        return F.when(when, row) if when is not None else row

    def lit(step, category):
        return F.lit(step), F.lit(category)
    names = F.array_join(F.transform("failed_names", lambda x: F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))), ", ")
    varied = (face == 5) & (F.coalesce("appearance_level", F.lit("MINIMAL")) != "MINIMAL")
    of_case = F.array_compact(F.array(
        reason(~F.col("is_identity_page"), *lit(0, "DOCUMENT_PAGE"), F.lit("CRITICAL"), None, F.lit("Identity Page Not Detected")),
        reason(mrz > 0, *lit(1, "MRZ_CHECKSUM"),
               F.when(~F.col("parsed"), "MEDIUM").when(F.col("composite_failed"), "CRITICAL").otherwise("HIGH"), mrz * WEIGHTS["mrz"],
               F.when(F.col("parsed"), F.concat(F.lit("MRZ Checksum Failure ("), names, F.lit(")"))).otherwise("MRZ Missing or Unreadable")),
        reason(face >= 30, *lit(4, "BIOMETRIC"), F.when(face == 85, "CRITICAL").otherwise("MEDIUM"), face * WEIGHTS["face"],
               F.when(face == 85, "Biometric Mismatch").when(face == 35, "Biometric Inconclusive").otherwise("Facial Capture Incomplete")),
        reason(varied, *lit(4, "BIOMETRIC"), F.lit("INFO"), F.lit(0.0), F.concat(F.lit("Appearance Variation: "), "appearance_level")),
        reason(F.col("duplicate"), *lit(5, "MULTI_IDENTITY"), F.lit("CRITICAL"), F.lit(25.0), F.lit("Multi-Identity Reuse Flagged")),
        reason(F.col("quality_verdict") == "NEEDS_BETTER_IMAGE", *lit(7, "QUALITY"), F.lit("MEDIUM"), F.lit(60.0 * WEIGHTS["quality"]),
               F.lit("Sub-Optimal Image Quality"))))
    out = c.select(F.col("id").alias("case_id"), F.inline(of_case))

    zone, severity = F.col("is_zone"), F.col("severity")
    label = F.concat(F.lit("Field Inconsistency: "), F.initcap(F.replace("field", F.lit("_"), F.lit(" "))))
    found = reason(None, F.when(zone, 2).otherwise(6), F.when(zone, "VIZ_MRZ_CROSS_CHECK").otherwise("RULES"), severity,
                   F.when(zone, viz_points(severity) * WEIGHTS["viz"]).otherwise(rule_points(severity) * WEIGHTS["rules"]),
                   F.when(zone, label).otherwise(F.col("rule_id")), F.col("seq"))
    out = out.unionByName(findings.select(F.col("screening_id").alias("case_id"), found.alias("r")).select("case_id", "r.*"))

    # (case, findings, score over the limit) from the findings' and the cases' side in one aggregate
    shares = (tamper.select("screening_id", F.lit(1).alias("_one"), F.lit(False).alias("_over"))
              .unionByName(cases.select(F.col("id").alias("screening_id"), F.lit(0).alias("_one"),
                                        (F.coalesce("tamper_score", F.lit(0.0)) >= 35).alias("_over")))
              .groupBy("screening_id").agg(F.sum("_one").alias("_n"), F.max("_over").alias("_over")).filter("_over and _n > 0"))
    marked = tamper.join(shares, "screening_id")
    tampered = reason(None, *lit(3, "FORENSICS"), severity, F.col("score") * (F.lit(WEIGHTS["tamper"]) / F.col("_n")),
                      F.col("technique"), F.col("seq"))
    return out.unionByName(marked.select(F.col("screening_id").alias("case_id"), tampered.alias("r")).select("case_id", "r.*"))


def order_reasons(reasons: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Place of each reason in its case: by severity, then in order of insertion.

    Counts per severity, signal and slice give what comes before in a long case, so no window has to hold
    it whole. The reasons come from many tables, so they are stored once; sizes are counted on their keys alone.
    """
    graded = stored(reasons.withColumn("_sev", severity_rank(F.col("severity"))), "reasons")
    return with_rank(graded, ["case_id"], "seq", slice_rows, "place", ahead=["_sev", "step"]).drop("_sev")


def top_reasons(reasons: DataFrame, k: int = 4) -> DataFrame:
    return top_per_group(reasons, ["case_id"], [severity_rank(F.col("severity")), F.col("step"), F.col("seq")], k, "place")


def reread_reasons(findings: DataFrame, tamper: DataFrame, faces: DataFrame, covers: DataFrame) -> DataFrame:
    """Reasons rebuilt from stored rows: cover pages, HIGH and CRITICAL findings, face outcomes."""
    def rows(df, category, severity, summary, key="screening_id"):
        return df.select(F.col(key).alias("case_id"), category.alias("category"), severity.alias("severity"),
                         summary.alias("summary"))
    grave = _is_severe(F.col("severity"))
    outcome = F.col("verification_result")
    crit = F.lit("CRITICAL")
    return (rows(covers, F.lit("DOCUMENT_PAGE"), crit, F.lit("Identity Page Not Detected"))
            .unionByName(rows(findings.filter(grave), F.col("category"), F.col("severity"), F.col("rule_id")))
            .unionByName(rows(tamper.filter(grave), F.lit("TAMPER_FORENSICS"), F.col("severity"),
                              F.concat(F.lit("Tampering anomaly: "), "technique")))
            .unionByName(rows(faces.filter(outcome == "INPUT_FAILURE"), F.lit("BIOMETRIC"), crit,
                              F.lit("Biometric Input Incomplete")))
            .unionByName(rows(faces.filter(outcome.isin("VERIFIED_MISMATCH", "MISMATCH")), F.lit("BIOMETRIC"), crit,
                              F.lit("Biometric Mismatch"))))
