"""Five date readers that differ on purpose, and the two-digit-year pivots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vetline.functions.text import MISSING_DATE, denull, let, lookup, squeeze

MONTHS_SHORT = {m: f"{i:02d}" for i, m in enumerate(
    "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}
MONTHS_FULL = {m: f"{i:02d}" for i, m in enumerate(
    "JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER".split(), 1)}
DATE_LABEL_PREFIX = r"^(?:DOB|DATE OF BIRTH|EXPIRY|EXPIRATION|DATE|VALID FROM|VALID UNTIL)[\s:.\-]*"


def pivot_year(yy: Column, last_recent: Column | int) -> Column:
    """Four-digit year: 20yy up to and including ``last_recent``, 19yy above."""
    limit = F.lit(last_recent) if isinstance(last_recent, int) else last_recent
    return F.when(yy <= limit, yy + 2000).otherwise(yy + 1900)


def yymmdd_to_iso(c: Column, last_recent: Column | int) -> Column:
    """Six digits to ISO text; month 1..12 and day 1..31 checked, not the calendar."""
    digits = F.when(c.rlike(r"^\d{6}$"), c)
    yy, mm, dd = (F.substring(digits, p, 2).cast("int") for p in (1, 3, 5))
    return F.when(mm.between(1, 12) & dd.between(1, 31), F.concat_ws(
        "-", pivot_year(yy, last_recent).cast("string"), F.substring(digits, 3, 2), F.substring(digits, 5, 2)))


def _pad(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def _joined(y: Column, m: Column, d: Column) -> Column:
    return F.concat(F.lpad(y, 4, "0"), F.lit("-"), _pad(m), F.lit("-"), _pad(d))


def _real_day(text: Column) -> Column:
    """The ISO text when it names a day of the calendar, else null."""
    return let(text, lambda t: F.when(F.try_to_date(t, "yyyy-MM-dd").isNotNull(), t))


def _part(c: Column, pattern: str) -> Column:
    """First group of the first match, null when there is none."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(1))


def _month(word: Column, names: dict[str, str]) -> Column:
    return lookup(names, F.upper(word))


def _shaped(t: Column, pattern: str, separator: str, build) -> Column:
    """``build`` on the parts of a text of a given shape, null for other shapes."""
    return let(F.when(t.rlike(pattern), F.split(t, separator)), build)


MONTHS_ANY = {**MONTHS_SHORT, **MONTHS_FULL}
NAMED_SHAPE = r"^\d{1,2}\s+[A-Za-z]+\s+\d{4}$"


def normalize_date(c: Column) -> Column:
    """Lenient reader: finds a date anywhere in the text, never checks the calendar,
    returns unreadable text as it is."""
    def read(raw):
        iso = let(F.split(_part(raw, r"\b(\d{4}[-/.]\d{2}[-/.]\d{2})\b"), "[-/.]"), lambda p: _joined(p[0], p[1], p[2]))
        named = let(F.split(_part(raw, r"\b(\d{1,2}[\s\-/.][A-Z]{3,9}[\s\-/.]\d{4})\b"), r"[\s\-/.]"),
                    lambda p: _joined(p[2], _month(F.left(p[1], F.lit(3)), MONTHS_SHORT), p[0]))
        numeric = let(F.split(_part(raw, r"\b(\d{1,2}[-/.]\d{1,2}[-/.]\d{4})\b"), "[-/.]"),
                      lambda p: _joined(p[2], p[1], p[0]))
        six = F.when(raw.rlike(r"^\d{6}$"), F.concat(
            F.when(F.left(raw, F.lit(2)) > "45", "19").otherwise("20"), F.left(raw, F.lit(2)), F.lit("-"),
            F.substring(raw, 3, 2), F.lit("-"), F.substring(raw, 5, 2)))
        return F.coalesce(iso, named, numeric, six, raw)
    return let(F.trim(F.regexp_replace(F.upper(denull(c, MISSING_DATE)), DATE_LABEL_PREFIX, "")), read)


def _named_day(t: Column) -> Column:
    return let(F.when(t.rlike(NAMED_SHAPE), F.split(squeeze(t), " ")),
               lambda p: _real_day(_joined(p[2], _month(p[1], MONTHS_ANY), p[0])))


def strict_date(c: Column) -> Column:
    """Whole-text reader with a calendar check; five formats; null otherwise."""
    def read(t):
        return F.coalesce(
            _shaped(t, r"^\d{4}-\d{2}-\d{2}$", "-", lambda p: _real_day(_joined(p[0], p[1], p[2]))),
            _shaped(t, r"^(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})$", "[/-]",
                    lambda p: _real_day(_joined(p[2], p[1], p[0]))),
            _named_day(t))
    return let(F.trim(c), read)


VISA_DATE_PATTERNS = [
    r"\b(\d{1,2}[/\-\s][A-Za-z]{3,9}[/\-\s]\d{4})\b",
    r"\b(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4})\b",
    r"\b(\d{4}[/\-]\d{2}[/\-]\d{2})\b",
]


def extract_visa_date(c: Column) -> Column:
    """First date-like text, named month before numeric before year-first."""
    return F.coalesce(*[_part(c, p) for p in VISA_DATE_PATTERNS])


def visa_date(c: Column) -> Column:
    """Reader for visa fields: four numeric formats, then day, month word, year."""
    def word(p):
        fits = (F.size(p) == 3) & p[0].rlike(r"^\d{1,2}$") & F.try_element_at(p, F.lit(3)).rlike(r"^\d{4}$")
        month = _month(F.left(F.try_element_at(p, F.lit(2)), F.lit(3)), MONTHS_SHORT)
        return F.when(fits, _real_day(_joined(F.try_element_at(p, F.lit(3)), month, p[0])))

    def read(t):
        return F.coalesce(
            _shaped(t, r"^\d{4}-\d{1,2}-\d{1,2}$", "-", lambda p: _real_day(_joined(p[0], p[1], p[2]))),
            _shaped(t, r"^(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}|\d{1,2}\.\d{1,2}\.\d{4})$", "[-/.]",
                    lambda p: _real_day(_joined(p[2], p[1], p[0]))),
            let(F.split(t, r"[\s/\-.]+"), word))
    return let(F.trim(c), read)


def display_date(c: Column) -> Column:
    """Reader of the report view: year first, day first, month word, six digits; calendar-checked."""
    def read(t):
        year = pivot_year(F.substring(t, 1, 2).try_cast("int"), 50).cast("string")
        return F.coalesce(
            _shaped(t, r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$", "[-/.]", lambda p: _real_day(_joined(p[0], p[1], p[2]))),
            _shaped(t, r"^\d{1,2}[-/.]\d{1,2}[-/.]\d{4}$", "[-/.]", lambda p: _real_day(_joined(p[2], p[1], p[0]))),
            _named_day(t),
            F.when(t.rlike(r"^\d{6}$"), _real_day(_joined(year, F.substring(t, 3, 2), F.substring(t, 5, 2)))))
    return let(F.trim(c), read)


def is_past(iso: Column, as_of: str) -> Column:
    """Whether midnight of an ISO day lies before the instant ``as_of``; null for no real day."""
    return F.try_to_date(iso, "yyyy-MM-dd").cast("timestamp_ntz") < F.lit(as_of).cast("timestamp_ntz")
