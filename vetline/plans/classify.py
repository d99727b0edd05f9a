"""Document class from the text of a page: rejected families first, then visa and passport evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline.functions import mrz
from vetline.plans.extraction import contains_any
from vetline.session import spread

# Fixed values.
COVER_WORDS = ["FRONT COVER", "PASSPORT COVER", "COVER", "PAGE 4-5", "PAGE 35-36", "ADDRESS PAGE",
               "OBSERVATION PAGE", "EMBASSY OF INDIA", "MINISTRY OF EXTERNAL AFFAIRS"]
IDENTITY_WORDS = ["GIVEN NAME", "SURNAME", "DATE OF BIRTH", "DATE DE NAISSANCE", "SEX", "SEXE", "NATIONALITY",
                  "NATIONALITE", "PLACE OF BIRTH", "PLACE OF ISSUE", "DATE OF EXPIRY", "IDENTITY PAGE"]
PASSPORT_NUMBER = r"\b([A-Z]\s*[0-9]{7,8})\b"


def _count(flags: list[Column]) -> Column:
    return sum((F.when(f, 1).otherwise(0) for f in flags), F.lit(0))


def rejected_family(t: Column, raw: Column) -> Column:
    """The first unsupported family whose marks occur, else null."""
    def has(*needles):
        return contains_any(t, list(needles))
    aadhaar = (t.rlike(r"\b(AADHAAR|AADHAR|UIDAI)\b") | has("MERA AADHAAR", "UNIQUE IDENTIFICATION", "ENROLMENT NO",
                                                           "ENROLLMENT NO") | raw.rlike(r"\b\d{4}\s\d{4}\s\d{4}\b"))
    pan = (has("INCOME TAX DEPARTMENT", "PERMANENT ACCOUNT NUMBER") | (has("GOVT. OF INDIA") & has("PAN"))
           | (t.rlike(r"\b[A-Z]{5}[0-9]{4}[A-Z]\b") & has("INCOME", "TAX", "FATHER", "PAN")))
    driving = (t.rlike(r"\b(DRIVING LICENCE|DRIVING LICENSE)\b") | has("MOTOR VEHICLES", "TRANSPORT DEPARTMENT", "FORM 7")
               | t.rlike(r"\bDL\s*(NO|NUM|:)") | t.rlike(r"\b[A-Z]{2}[0-9]{2}[0-9]{11}\b"))
    voter = (has("ELECTION COMMISSION", "ELECTOR PHOTO", "VOTER ID")
             | (t.rlike(r"\b[A-Z]{3}[0-9]{7}\b") & has("ELECT", "VOTER")))
    badge = (t.rlike(r"\b(STUDENT ID|STUDENT IDENTITY|COLLEGE OF|UNIVERSITY|CAMPUS)\b")
             | t.rlike(r"\b(EMPLOYEE ID|STAFF CARD|EMPLOYEE IDENTITY|STAFF ID)\b") | has("ROLL NO"))
    national = has("NATIONAL IDENTITY CARD", "CITIZEN CARD", "RESIDENCE PERMIT")
    return (F.when(aadhaar, "AADHAAR").when(pan, "PAN").when(driving, "DRIVING_LICENCE").when(voter, "VOTER_ID")
            .when(badge, "STUDENT_OR_EMPLOYEE_ID").when(national, "NATIONAL_ID"))


def classify_text(docs: DataFrame, key: str, text: str) -> DataFrame:
    """verdict, detected_type, page_type and confidence per document.

    ``text`` holds the lines of a page separated by line feeds; patterns run over the
    lines joined by blanks.
    """
    lines = F.split(F.col(text), "\n")

    def zone_line(x):
        b = mrz.bare(x)
        return ((b.startswith("P<") | b.startswith("P0") | b.startswith("P«") | (mrz.filler_count(b) >= 4))
                & (F.length(b) >= 25))
    df = spread(docs).select(
        key, F.translate(F.col(text), "\n", " ").alias("_raw"), F.size(lines).alias("_lines"),
        F.size(F.filter(lines, zone_line)).alias("_zones"),
        F.exists(lines, lambda x: mrz.bare(x).startswith("P<")).alias("_p_line"),
        F.exists(lines, lambda x: mrz.bare(x).rlike("^V[<0«]")).alias("_v_line"))
    df = df.withColumn("_t", F.upper("_raw"))
    t, zones = F.col("_t"), F.col("_zones")

    number = t.rlike(PASSPORT_NUMBER)
    p_code = t.rlike(r"\bP\s+IND\b")
    page_word = t.contains("IDENTITY PAGE")
    passport_marks = [
        zones >= 1, t.rlike(r"\b(PASSPORT|PASSEPORT|PASAPORTE)\b"),
        contains_any(t, ["REPUBLIC OF INDIA", "UNION OF INDIA", "INDIAN PASSPORT"]),
        number & (t.contains("PASSPORT") | (zones >= 1)),
        t.contains("TYPE P") | t.rlike(r"\bTYPE\s*[:/]?\s*P\b") | p_code | page_word]
    visa_word = t.rlike(r"\b(VISA|VIZUM|VISA VIGNETTE)\b")
    visa_number = t.rlike(r"\b(VISA NO|VISA NUMBER|VIGNETTE NO)[\s:.]*([A-Z0-9]{6,12})\b")
    visa_loose = ~visa_word & t.contains("VISA") & contains_any(t, ["ENTRIES", "VALID FOR", "DURATION OF STAY"])
    # marks whose wording names the visa count as naming it
    naming = [F.col("_v_line"), visa_word | visa_loose, t.rlike(r"\b(VISA TYPE|TYPE OF VISA|VISA CATEGORY|CATEGORY)\b"),
              t.rlike(r"\b(ENTRIES|NO OF ENTRIES|NUMBER OF ENTRIES|ENTRY)\b"),
              t.rlike(r"\b(VALID FROM|VALID UNTIL|DATE OF EXPIRY|EXPIRY DATE)\b"), visa_number]
    stay = t.rlike(r"\b(DURATION OF STAY|PERIOD OF STAY|STAY FOR)\b")
    df = df.withColumns({
        "_family": rejected_family(t, F.col("_raw")), "_pm": _count(passport_marks), "_vm": _count([*naming, stay]),
        "_named": _count(naming), "_number": number, "_ids": _count([t.contains(w) for w in IDENTITY_WORDS]),
        "_cover": contains_any(t, COVER_WORDS), "_code": p_code, "_page": page_word})
    is_passport = ((zones >= 1) & (F.col("_pm") >= 2)) | (zones >= 2) | (
        t.contains("PASSPORT") & (t.contains("REPUBLIC") | F.col("_number"))) | (
        t.contains("REPUBLIC OF INDIA") & (F.col("_code") | F.col("_page") | F.col("_number")))
    is_visa = ((F.col("_vm") >= 2) & ((F.col("_named") > 0) | t.contains("VISA"))) | F.col("_v_line")
    identity = F.when(F.col("_cover") & ~(F.col("_page") | (F.col("_ids") >= 2)), False).otherwise(
        (zones >= 1) | (F.col("_ids") >= 2) | F.col("_page") | ((F.col("_ids") >= 1) & F.col("_number")))
    df = df.withColumns({"_is_p": is_passport, "_is_v": is_visa, "_id": identity})
    genuine = (zones >= 2) & F.col("_p_line")
    as_passport = F.col("_is_p") & (~F.col("_is_v") | (genuine & (F.col("_vm") < 3)))
    verdict = (F.when(F.col("_family").isNotNull(), "UNSUPPORTED_DOCUMENT").when(as_passport, "PASSPORT")
               .when(F.col("_is_v"), "VISA")
               .when((F.col("_lines") < 2) | (F.length(F.trim("_t")) < 20), "UNABLE_TO_CLASSIFY")
               .otherwise("UNSUPPORTED_DOCUMENT"))
    df = df.withColumn("verdict", verdict)
    v = F.col("verdict")
    rejected = F.col("_family").isNotNull()
    confidence = (
        F.when(rejected, F.when(F.col("_family").isin("AADHAAR", "PAN"), 0.98).when(
            F.col("_family") == "DRIVING_LICENCE", 0.95).when(F.col("_family") == "VOTER_ID", 0.96).when(
            F.col("_family") == "NATIONAL_ID", 0.90).otherwise(0.92))
        .when(v == "PASSPORT", F.when(zones >= 2, 0.98).otherwise(0.90))
        .when(v == "VISA", F.when((F.col("_vm") >= 3) | F.col("_v_line"), 0.95).otherwise(0.85))
        .when(v == "UNABLE_TO_CLASSIFY", 0.2).otherwise(0.85))
    detected = (F.when(rejected, F.col("_family"))
                .when(v == "PASSPORT", F.when(F.col("_id"), "PASSPORT").otherwise("PASSPORT_COVER"))
                .when(v == "VISA", "VISA").when(v == "UNABLE_TO_CLASSIFY", "RANDOM_OR_UNREADABLE")
                .otherwise("OTHER_DOCUMENT"))
    page = (F.when(v == "PASSPORT", F.when(F.col("_id"), "PASSPORT_IDENTITY_PAGE").otherwise("PASSPORT_COVER"))
            .when(v == "VISA", "VISA_VIGNETTE"))
    return df.select(key, v, detected.alias("detected_type"), page.alias("page_type"), confidence.alias("confidence"))
