"""Reading labelled fields from the text lines of a page.

A page is one row, so its lines, their three followers and the candidate values
of every line stay arrays inside that row: no explode, no sort and no shuffle,
whatever the size of the table. The first line with a value wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline.functions import mrz
from vetline.functions.dates import extract_visa_date
from vetline.functions.text import clean_name_tokens, clean_names_text, each, full_name, let, let_sql, noise_text
from vetline.operators.ordered import SLICE_ROWS, with_earlier_max
from vetline.session import spread, stored

AHEAD = ("next1", "next2", "next3")


def with_lines(df: DataFrame, text: str, lines: str = "lines", variant: str | None = None) -> DataFrame:
    """Add an array of structs, one per text line: line, next1..next3; with a ``variant`` also
    name1..name3, the name words of the following lines, cleaned once per line."""
    df = df.withColumn(lines, F.split(F.col(text), "\n"))
    sources = {"next": lines}
    if variant:
        df = df.withColumn("_names", F.call_function("transform", F.col(lines), F.expr(clean_names_text(variant))))
        sources["name"] = "_names"
    n = F.size(lines)
    ahead = [F.slice(src, F.lit(k + 1), F.greatest(n - k, F.lit(0))).alias(f"{name}{k}")
             for name, src in sources.items() for k in (1, 2, 3)]
    return df.withColumn(lines, F.arrays_zip(F.col(lines).alias("line"), *ahead)).drop("_names")


def staged(df: DataFrame, lines: str, derive) -> DataFrame:
    """Add fields to every line struct; ``derive`` maps a field accessor to named columns."""
    fields = [f.name for f in df.schema[lines].dataType.elementType.fields]

    def one(x):
        return F.struct(*[x[f].alias(f) for f in fields], *[c.alias(n) for n, c in derive(lambda f: x[f]).items()])
    return df.withColumn(lines, F.transform(lines, one))


def candidates(df: DataFrame, key: str, lines: str, derive) -> DataFrame:
    """(key, c): per line a struct of candidate values."""
    return df.select(key, F.transform(lines, lambda x: F.struct(
        *[c.alias(n) for n, c in derive(lambda f: x[f]).items()])).alias("c"))


def first_of(name: str) -> Column:
    """Value of the first line that has one."""
    return F.try_element_at(F.array_compact(F.col("c").getField(name)), F.lit(1))


def first_line_of(name: str) -> Column:
    """1-based number of that line, null when there is none."""
    at = F.array_position(F.transform(F.col("c").getField(name), lambda v: v.isNotNull()), True)
    return F.nullif(at, F.lit(0))


def line_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) for every line of every page."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def adjacent_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each line with the one after it."""
    rows = with_lines(df, text).select(key, F.posexplode("lines").alias("line_no", "l"))
    return rows.filter("l.next1 is not null").select(key, "line_no", F.col("l.line").alias("first"),
                                                     F.col("l.next1").alias("second"))


def contains_any(c: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null when there is none."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(1))


# -- visa ------------------------------------------------------------------------

VISA_TYPES = ["TOURIST", "STUDENT", "BUSINESS", "TRANSIT", "CONFERENCE", "VISITOR", "DIPLOMATIC", "OFFICIAL",
              "EMPLOYMENT", "ENTRY"]
VISA_NATIONS = ["INDIAN", "IND", "USA", "GBR", "CAN", "AUS", "FRA", "DEU", "JPN", "SGP", "ARE"]
ZONE_DATA = r"^([A-Z0-9]{7,10})\d([A-Z]{3})(\d{6})\d([MF<])(\d{6})"
DEMOGRAPHIC = r"([MFI]|\bMALE\b|\bFEMALE\b)?\s*(\d{1,2}\s*[A-Za-z]{3,9}\s*\d{4})\s+([A-Za-z]+)\s+([A-Z0-9]{7,10})"
VALIDITY = (r"\b(TOURIST|STUDENT|BUSINESS|TRANSIT|CONFERENCE|VISITOR|DIPLOMATIC)\b.*?"
            r"(\d{1,2}\s*[A-Za-z0-9]{3,9}\s*\d{4})\s+(\d{1,2}\s*[A-Za-z0-9]{3,9}\s*\d{4})")
LABELLED_NUMBER = (r"\b(?:VISA\s*(?:NO|NUMBER|NUM|#)?[\s:.]*|VIGNETTE\s*(?:NO|#)?[\s:.]*)"
                   r"([A-Z0-9]*\d[A-Z0-9]{5,11})\b")
LOOSE_NUMBER = r"\b([A-Z]{1,3}\s*\d{7,8}|[A-Z]\d\s*\d{7})\b"
STAY = r"\b(\d{1,3})\s*(DAYS|DAY|MONTHS|MONTH)\b"
PASSPORT_LABELS = ["PASSPORT", "DOC NO", "PPT NO", "PASSEPORT"]
PASSPORT_WORDS = ["PASSPORT", "PASSEPORT", "REPUBLIC", "CATEGORY", "OFFICIAL"]


_NOT_NOISE = f"c -> case when not {noise_text('c', 'visa')} then c end"


def _unless_noise(c: Column) -> Column:
    return let_sql(c, _NOT_NOISE)


def _name_after(at, label: str, stop: list[str], variant: str) -> Column:
    """Name on the label's own line, else on the first of the next three lines that is one."""
    own = clean_name_tokens(F.trim(F.regexp_replace(at("t"), label, "")), variant)
    later = [F.when(~contains_any(F.upper(at(a)), stop) & (at(f"name{i}") != ""), at(f"name{i}"))
             for i, a in enumerate(AHEAD, 1)]
    return let(own, lambda o: F.coalesce(F.when(o != "", o), *later))


def _english_nation(c: Column) -> Column:
    return F.when(c.isin("INDIAN", "IND"), "INDIAN").otherwise(c)


def _visa_matches(at) -> dict[str, Column]:
    """Stage: whole matches that several fields read. Cheap tests keep most lines away from
    the long patterns."""
    t, z = at("t"), at("z")
    has_digit = t.rlike("[0-9]")
    after = F.regexp_replace(t, r".*(?:PASSPORT|DOC|PPT|PASSEPORT)[\s:./#]*(?:NO|NUMBER)?[\s:./]*", "")
    return {
        "zone": F.when(has_digit, found(z, ZONE_DATA, 0)), "demo": F.when(has_digit, found(t, DEMOGRAPHIC, 0)),
        "valid": F.when(has_digit, found(t, VALIDITY, 0)),
        "labelled": F.when(has_digit & contains_any(t, ["VISA", "VIGNETTE"]), found(t, LABELLED_NUMBER)),
        "loose": F.when(has_digit, F.trim(found(t, LOOSE_NUMBER))),
        "near": F.when(has_digit & contains_any(t, PASSPORT_LABELS), found(F.trim(after), r"\b([A-Z0-9]{7,10})\b")),
        "dated": F.when(has_digit, extract_visa_date(at("raw"))),
    }


def _zone_values(at) -> dict[str, Column]:
    """What the machine-readable lines of a visa say."""
    z, m = at("z"), at("zone")
    header = z.startswith("V<") & (F.length(z) >= 20)

    def part(i):
        return F.when(header, let(F.split(z.substr(F.lit(6), F.length(z)), "<<"), lambda parts: F.when(
            F.size(parts) >= 2, _unless_noise(F.trim(F.replace(F.try_element_at(parts, F.lit(i)), F.lit("<"), F.lit(" ")))))))
    code = found(m, ZONE_DATA, 4)
    return {
        "z_surname": part(1), "z_given_names": part(2),
        "z_visa_number": let(found(m, ZONE_DATA, 1), lambda n: F.when(F.length(n) >= 6, n)),
        "z_nationality": let(found(m, ZONE_DATA, 2), lambda n: F.when(n == "IND", "INDIAN").otherwise(n)),
        "z_sex": let(code, lambda c: F.when(c == "M", "MALE").when(c == "F", "FEMALE")),
    }


def _visa_values(at) -> dict[str, Column]:
    t, demo = at("t"), at("demo")

    def clean_date(group):
        return let(F.replace(found(at("valid"), VALIDITY, group), F.lit("0CT"), F.lit("OCT")), lambda d: F.coalesce(
            found(d, r"(\d{1,2}\s*[A-Za-z]{3,9}\s*\d{4})"), F.trim(d)))

    def dated(labels):
        return F.when(contains_any(t, labels), at("dated"))

    def sex_text(c):
        return let(c, lambda w: F.when(w.isin("M", "MALE", "I"), "MALE").when(w != "", "FEMALE"))

    near = at("near")
    anywhere = F.filter(F.regexp_extract_all(t, F.lit(r"\b([A-Z0-9]{7,10})\b"), F.lit(1)),
                        lambda w: w.rlike("[0-9]") & w.rlike("[A-Z]") & ~w.isin(*PASSPORT_WORDS))
    passport = F.when(contains_any(t, PASSPORT_LABELS), F.when(
        near.isNotNull(), F.when(near.rlike("[0-9]") & ~near.isin("PASSPORT", "PASSEPORT", "REPUBLIC"),
                                 _unless_noise(near))).otherwise(F.try_element_at(anywhere, F.lit(1))))
    nation = F.when(contains_any(t, ["NATIONALITY", "CITIZENSHIP", "NATIONALITE"]), _english_nation(
        F.coalesce(*[F.when(t.contains(n), n) for n in VISA_NATIONS])))
    return {
        "surname": F.when(contains_any(t, ["SURNAME", "NOM"]), _name_after(
            at, r".*(?:SURNAME|NOM)[\s:./\-]*", ["GIVEN", "PRENOM", "SEX", "PASSPORT", "VISA"], "visa")),
        "given_names": F.when(contains_any(t, ["GIVEN", "PRENOM"]), _name_after(
            at, r".*(?:GIVEN[\sA-Z]*|PRENOM[S]?)[\s:./\-]*", ["SURNAME", "NOM", "SEX", "PASSPORT", "VISA"], "visa")),
        "visa_number": F.when(at("labelled").isNotNull(), _unless_noise(at("labelled"))).otherwise(
            _unless_noise(at("loose"))),
        "visa_type": F.coalesce(found(at("valid"), VALIDITY, 1), F.when(
            t.rlike(rf"\b(?:{'|'.join(VISA_TYPES)})\b"),
            F.coalesce(*[F.when(t.rlike(rf"\b{v}\b"), v) for v in VISA_TYPES]))),
        "passport_number": F.coalesce(let(found(demo, DEMOGRAPHIC, 4), lambda n: F.when(
            n.rlike("[0-9]"), _unless_noise(n))), passport),
        "nationality": F.coalesce(let(found(demo, DEMOGRAPHIC, 3), lambda n: _unless_noise(_english_nation(n))), nation),
        "date_of_birth": F.coalesce(F.trim(found(demo, DEMOGRAPHIC, 2)), dated(["BIRTH", "DOB", "NAISSANCE"])),
        "sex": F.coalesce(sex_text(found(demo, DEMOGRAPHIC, 1)), F.when(
            contains_any(t, ["SEX", "GENDER"]), sex_text(found(t, r"\b(MALE|FEMALE|M|F)\b")))),
        "valid_from": F.coalesce(clean_date(2), dated(["VALID FROM", "VALIDE DU", "FROM", "DU:"])),
        "valid_until": F.coalesce(clean_date(3), dated(
            ["VALID UNTIL", "VALIDE JUSQU", "UNTIL", "EXPIRY", "EXPIRATION"])),
        "entries": F.when(t.contains("MULT"), "MULTIPLE").when(
            t.contains("SINGLE") | t.rlike(r"\b0?1\s*ENTRY\b"), "SINGLE").when(
            t.contains("DOUBLE") | t.rlike(r"\b0?2\s*ENTRIES\b"), "DOUBLE"),
        "stay_duration": F.concat(found(t, STAY, 1), F.lit(" "), found(t, STAY, 2)),
    }


VISA_VALUES = ("surname given_names visa_number visa_type passport_number nationality date_of_birth sex valid_from "
               "valid_until entries stay_duration").split()
ZONE_VALUES = ("surname", "given_names", "visa_number", "nationality", "sex")


def visa_fields(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Thirteen visa fields per page, null where nothing was found. Machine-readable lines
    come before printed ones."""
    df = with_lines(spread(pages), text, variant="visa")
    df = staged(df, "lines", lambda at: {"raw": F.trim(at("line")), "t": F.upper(F.trim(at("line"))),
                                         "z": mrz.bare(at("line"))})
    df = staged(df, "lines", _visa_matches)
    df = candidates(df, key, "lines", lambda at: {**_zone_values(at), **_visa_values(at)})
    df = df.select(key, *[F.coalesce(*([first_of(f"z_{n}")] if n in ZONE_VALUES else []), first_of(n)).alias(n)
                          for n in VISA_VALUES])
    df = df.withColumn("holder_name", full_name(F.col("given_names"), F.col("surname")))
    names = [*VISA_VALUES, "holder_name"]
    df = df.select(key, each([F.col(n) for n in names], _NOT_NOISE).alias("v"))
    return df.select(key, *[F.col("v")[i].alias(n) for i, n in enumerate(names)])


# -- passport ----------------------------------------------------------------------

DOC_NUMBER = r"\b([A-Z][0-9]{7,8}|[A-Z0-9][0-9]{7}|[0-9]{8})\b"
DATE_TEXT = (r"\b(\d{1,2}[/\-\s][A-Za-z]{3,9}[/\-\s]\d{4}|\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}|"
             r"\d{4}[/\-]\d{2}[/\-]\d{2})\b")
NUMBER_LABELS = ["PASSPORT NO", "PASSPORT NUMBER", "DOCUMENT NO", "PASSEPORT", "PASSPORT", "IND"]
EXPIRY_LABELS = ["EXPIRY", "EXPIRATION", "VALID UNTIL", "EXP"]


def _all_dates(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(DATE_TEXT), F.lit(1))


def _passport_values(at) -> dict[str, Column]:
    t = at("t")
    ahead = [F.upper(at(a)) for a in AHEAD]
    number = found(t, DOC_NUMBER)
    in_context = contains_any(t, ["IND", "PASSPORT", "NO", "P "]) | (F.size(F.split(F.trim(t), r"\s+")) <= 4)
    any_number = let(number, lambda n: F.when(n.isNotNull(), F.when(in_context, n)).when(
        contains_any(t, NUMBER_LABELS), F.coalesce(*[found(a, DOC_NUMBER) for a in ahead])))
    surname = F.when(contains_any(t, ["SURNAME", "SUMAME", "SURNAM", "NOM", "उपपनाम"]), _name_after(
        at, r".*(SURNAME|SUMAME|SURNAM|NOM|उपपनाम)[\s:./]*", ["GIVEN", "PRENOM", "DATE", "SEX", "PASSPORT"], "reader"))
    given = F.when(contains_any(t, ["GIVEN", "PRENOM"]), _name_after(
        at, r".*(GIVEN[\sA-Z]*|PRENOM[S]?)[\s:./]*", ["DATE", "SEX", "BIRTH", "PASSPORT", "IND"], "reader"))

    own_name = clean_name_tokens(F.trim(F.regexp_replace(t, r".*(FULL NAME|NAME OF HOLDER)[\s:./]*", "")), "reader")
    holder = F.when(contains_any(t, ["FULL NAME", "NAME OF HOLDER"]), let(own_name, lambda o: F.coalesce(
        F.when(F.length(o) > 3, o),
        *[F.when((F.length(at(f"name{i}")) > 3) & ~contains_any(a, ["PASSPORT", "REPUBLIC", "NATIONALITY"]), at(f"name{i}"))
          for i, a in enumerate(ahead, 1)])))

    birth = F.when(contains_any(t, ["BIRTH", "BITH", "DOB", "NAISSANCE", "JANM"]),
                   F.coalesce(*[found(at(c), DATE_TEXT) for c in ("line", *AHEAD)]))
    later = F.concat(*[_all_dates(at(a)) for a in AHEAD])
    expiry = F.when(contains_any(t, EXPIRY_LABELS), F.coalesce(
        found(at("line"), DATE_TEXT), F.try_element_at(later, F.lit(-1))))
    nation = F.when(contains_any(t, ["NATIONALITY", "CITIZENSHIP", "INDIAN"])
                    & F.concat_ws(" ", t, *ahead).contains("IND"), "INDIAN")

    def sex_in(c):
        return F.coalesce(found(c, r"\b(MALE|FEMALE)\b"), found(c, r"\b([MF])\b"))
    sex = F.when(t.rlike(r"\b(SEX|GENDER|SEXE|SOX)\b"), let(
        F.coalesce(sex_in(t), *[sex_in(a) for a in ahead]),
        lambda w: F.when(w.isin("MALE", "M"), "MALE").when(w.isNotNull(), "FEMALE")))

    # dates anywhere: the first of an early year is a birth, the first of a late year an expiry
    def of_years(test):
        return F.try_element_at(F.filter(at("dates"), lambda d: test(F.regexp_extract(
            d, r"\b(19\d{2}|20\d{2})\b", 1))), F.lit(1))
    early = of_years(lambda y: (y != "") & (y < "2018"))
    return {
        "document_number": any_number, "surname": F.element_at(F.split(surname, " "), 1), "given_names": given,
        "holder": holder, "nationality": nation, "birth": birth, "expiry": expiry, "sex": sex, "early": early,
        "early_sex": F.when(early.isNotNull(), F.when(t.rlike(r"\bM\b"), "MALE").when(
            t.rlike(r"\bF\b"), "FEMALE").otherwise("")),
        "late": of_years(lambda y: y >= "2025"),
    }


def passport_fields(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Eight identity fields per page, with a pass over all dates for what is still missing."""
    df = with_lines(spread(pages), text, variant="reader")
    df = staged(df, "lines", lambda at: {"t": F.upper(at("line")), "dates": _all_dates(at("line"))})
    df = candidates(df, key, "lines", _passport_values)
    names = ["document_number", "surname", "given_names", "holder", "nationality", "birth", "expiry", "sex", "early",
             "early_sex", "late"]
    page = df.select(key, *[first_of(n).alias(n) for n in names],
                     F.greatest(first_line_of("surname"), first_line_of("given_names")).alias("composed_at"),
                     first_line_of("holder").alias("holder_at"))
    both = F.col("surname").isNotNull() & F.col("given_names").isNotNull()
    return page.select(
        key, "document_number", "surname", "given_names",
        F.when(both & (F.col("holder_at").isNull() | (F.col("composed_at") <= F.col("holder_at"))),
               full_name(F.col("given_names"), F.col("surname"))).otherwise(F.col("holder")).alias("full_name"),
        "nationality", F.coalesce("birth", "early").alias("date_of_birth"),
        F.coalesce("expiry", "late").alias("date_of_expiry"),
        F.coalesce("sex", F.when(F.col("birth").isNull(), F.nullif("early_sex", F.lit("")))).alias("sex"))


# -- machine-readable pair of a page -------------------------------------------------

def candidate_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), mrz.is_candidate_line))


def line_score(line: Column) -> Column:
    """A line's share in the score of a pair; a pair's score is the sum of both."""
    t = mrz.bare(line)
    return (F.when(t.startswith("P<") | t.startswith("V<"), 10).otherwise(0) + F.when(t.contains("<<"), 5).otherwise(0)
            + F.when(t.contains("IND"), 3).otherwise(0) + F.least(mrz.filler_count(t), F.lit(8))).cast("int")


def candidate_lines(lines: DataFrame, key: str, as_of: str) -> DataFrame:
    """Candidate lines with what decides a pair: header look, decodable in either role, checks, score."""
    c = spread(lines).filter(mrz.is_candidate_line(F.col("line"))).select(key, F.col("line_no").cast("bigint").alias("line_no"),
                                                                  "line")
    c = mrz.normalise_data(mrz.normalise_header(c, "line", "_as_header"), "line", "_as_data")
    c = mrz.decode_data(c, "_as_data", as_of)
    return c.select(key, "line_no", "line", mrz.starts_like_header(F.col("line")).alias("is_header"),
                    (F.length("_as_header") == mrz.LINE).alias("header_ok"),
                    (F.length("_as_data") == mrz.LINE).alias("data_ok"),
                    F.col("all_checks_passed").alias("data_valid"), line_score(F.col("line")).alias("score"))


def best_earlier_partner(cands: DataFrame, key: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """For every candidate line the best decodable pair with an earlier line.

    A pair's worth (valid, score) is a sum over its two lines, so the best earlier
    partner is a running maximum: linear in the lines, no pair is ever built.
    """
    def state(valid):
        return F.struct(valid.alias("valid"), F.col("score"), (-F.col("line_no")).alias("neg"))
    no = F.lit(False)
    cands = stored(cands, "candidates")            # few of the lines, and costly to decode
    marked = with_earlier_max(cands, [key], "line_no", {
        "first_any": F.when(F.col("header_ok"), state(no)),
        "first_head": F.when(F.col("header_ok") & F.col("is_header"), state(no)),
        "data_plain": F.when(F.col("data_ok") & ~F.col("is_header"), state(F.col("data_valid"))),
    }, slice_rows)
    # this line as data below an earlier header, or as header of an earlier data line
    upper = F.when(F.col("is_header"), F.col("first_head")).otherwise(F.col("first_any"))
    as_data = F.when(F.col("data_ok") & upper.isNotNull(), F.struct(
        F.col("data_valid").alias("valid"), (upper["score"] + F.col("score")).alias("score"),
        upper["neg"].alias("neg"), (-F.col("line_no")).alias("neg_own")))
    lower = F.col("data_plain")
    as_header = F.when(F.col("header_ok") & F.col("is_header") & lower.isNotNull(), F.struct(
        lower["valid"].alias("valid"), (lower["score"] + F.col("score")).alias("score"),
        lower["neg"].alias("neg"), (-F.col("line_no")).alias("neg_own")))
    best = F.greatest(as_data, as_header)
    out = marked.withColumn("best", F.coalesce(best, as_data, as_header)).filter("best is not null")
    return out.select(key, (-F.col("best.neg")).alias("first_no"), F.col("line_no").alias("second_no"),
                      F.col("best.valid").alias("valid"), F.col("best.score").alias("score"))


def best_pair(cands: DataFrame, key: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One pair per page: valid before decodable, then the score, then the order of lines."""
    pairs = best_earlier_partner(cands, key, slice_rows)
    worth = F.struct("valid", "score", -F.col("first_no"), -F.col("second_no"))
    best = pairs.groupBy(key).agg(F.max_by(F.struct("first_no", "second_no", "valid", "score"), worth).alias("b"))
    return best.select(key, "b.*")
