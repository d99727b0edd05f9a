"""Machine-readable zone (two lines of 44) as staged column expressions.

Each stage is its own projection, so a long repair chain stays linear in size
and the text work runs inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline.functions.dates import is_past, yymmdd_to_iso
from vetline.session import spread

# Fixed values of the standard and of the usual misreadings.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WEIGHTS = [7, 3, 1]
DIGITS_FOR_LETTERS = ("ODQILZS", "0001125")
LETTERS_FOR_DIGITS = ("0158", "OISB")
MISREAD_IND = ["1ND", "TND", "LND"]
CHECKS = ["document_number", "date_of_birth", "date_of_expiry", "optional_data", "composite"]
LINE = 44


VALUES_MOD_10 = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ<", "012345678901234567890123450")


def digit_values(c: Column) -> Column:
    """Each character's value modulo 10, as a digit; only that matters for the sum."""
    return F.translate(F.upper(c), *VALUES_MOD_10)


def check_digit(c: Column) -> Column:
    """Weighted 7-3-1 sum modulo 10, as text. Letters count from 10, filler as 0."""
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    terms = F.transform(F.split(digit_values(c), ""), lambda ch, i: F.coalesce(
        ch.try_cast("int"), F.lit(0)) * weights[F.pmod(i, F.lit(3))])
    return F.pmod(F.aggregate(terms, F.lit(0), lambda acc, x: acc + x), F.lit(10)).cast("string")


def check_digit_of(values: str, width: int) -> Column:
    """The same for a column of digit values of a known width: unrolled, inside code generation."""
    terms = [f"{WEIGHTS[i % 3]} * (ascii(substr({values}, {i + 1}, 1)) - 48)" for i in range(width)]
    return F.expr(f"cast(pmod({' + '.join(terms)}, 10) as string)")


def as_digits(c: Column) -> Column:
    return F.translate(c, *DIGITS_FOR_LETTERS)


def as_letters(c: Column) -> Column:
    return F.translate(c, *LETTERS_FOR_DIGITS)


def bare(c: Column) -> Column:
    return F.upper(F.replace(c, F.lit(" "), F.lit("")))


def starts_like_header(c: Column) -> Column:
    t = bare(c)
    return t.startswith("P<") | t.startswith("P0") | t.startswith("V<")


def filler_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("<"), F.lit("")))


def is_candidate_line(c: Column) -> Column:
    t = bare(c)
    return ((starts_like_header(c) | t.startswith("P«") | (filler_count(t) >= 2)) & (F.length(t) >= 15))


def _cut_from(c: Column, start: Column) -> Column:
    return F.when(start > 1, c.substr(start, F.length(c))).otherwise(c)


def _fit(c: Column) -> Column:
    return F.when(F.length(c) >= 35, F.rpad(F.left(c, F.lit(LINE)), LINE, "<")).otherwise(c)


def normalise_header(df: DataFrame, source: str, target: str) -> DataFrame:
    """First line: noise to filler, align to the document code, repair the country, clean trailing noise."""
    t = "_h"
    df = df.withColumn(t, F.regexp_replace(F.regexp_replace(
        F.upper(F.trim(F.coalesce(F.col(source), F.lit("")))), r"[\s«»\-_/]+", "<"), "[^A-Z0-9<]", "<"))
    exact = F.instr(F.col(t), "P<")
    df = df.withColumn(t, _cut_from(F.col(t), F.when(exact > 0, exact).otherwise(
        F.regexp_instr(F.col(t), F.lit("P[<0A-Z]")))))
    df = df.withColumn(t, F.regexp_replace(F.regexp_replace(
        F.col(t), "^P<(?:ND|[1TL]ND)", "P<IND"), "<<([A-Z0-9]+)K<", "<<$1<<"))
    df = df.withColumn("_hp", F.split(F.col(t), "<<"))
    tail = F.when(F.size("_hp") > 2, F.concat(F.lit("<<"), F.array_join(
        F.slice(F.col("_hp"), F.lit(3), F.greatest(F.size("_hp") - 2, F.lit(0))), "<<"))).otherwise(F.lit(""))
    joined = F.concat(F.array_join(F.slice("_hp", 1, 2), "<<"), F.regexp_replace(tail, "[KEXC<]", "<"))
    return df.withColumn(t, F.when(F.size("_hp") >= 2, joined).otherwise(F.col(t))).withColumn(
        target, _fit(F.col(t))).drop(t, "_hp")


def normalise_data(df: DataFrame, source: str, target: str) -> DataFrame:
    """Second line: noise to filler, align to number plus check digit, clean the optional zone."""
    t = "_d"
    df = df.withColumn(t, F.regexp_replace(F.regexp_replace(
        F.upper(F.trim(F.coalesce(F.col(source), F.lit("")))), r"[\s«»\-_/]+", "<"), "[^A-Z0-9<]", "<"))
    df = df.withColumn(t, _cut_from(F.col(t), F.regexp_instr(F.col(t), F.lit("[A-Z0-9<]{9}[0-9]"))))
    n = F.length(F.col(t))
    middle = F.when(n >= LINE, F.substring(t, 29, 14)).otherwise(F.col(t).substr(F.lit(29), n))
    rest = F.when(n >= LINE, F.col(t).substr(F.lit(43), n)).otherwise(F.lit(""))
    cleaned = F.concat(F.substring(t, 1, 28), F.regexp_replace(middle, "[KEXC<]", "<"), rest)
    return df.withColumn(t, F.when(n >= 30, cleaned).otherwise(F.col(t))).withColumn(
        target, _fit(F.col(t))).drop(t)


def _country(c: Column) -> Column:
    t = F.replace(c, F.lit("<"), F.lit(""))
    return F.when(t.isin(*MISREAD_IND), F.lit("IND")).otherwise(t)


SCRATCH = ["_l", "_s", "_sex"] + [f"_{n}" for n in ("num", "dob", "exp", "opt")] + [
    f"_{n}_c" for n in ("num", "dob", "exp", "opt", "all")] + [
    f"_{k}_{n}" for k in "ev" for n in ("num", "dob", "exp", "opt", "all")]


def decode_data(df: DataFrame, line: str, as_of: str) -> DataFrame:
    """Fields and check digits of a normalised second line (null fields unless 44 long)."""
    l2 = F.when(F.length(line) == LINE, F.col(line))
    df = df.withColumn("_l", l2)
    sex_at = F.lit(21)
    for pos in (23, 20, 22, 21):
        sex_at = F.when(F.substring("_l", pos, 1).isin("M", "F"), F.lit(pos)).otherwise(sex_at)
    df = df.withColumn("_s", sex_at)
    s, at = F.col("_l"), F.col("_s")
    df = df.withColumns({
        "_num": F.substring("_l", 1, 9), "_num_c": F.substring("_l", 10, 1),
        "_dob": as_digits(F.substring("_l", 14, 6)), "_dob_c": as_digits(F.substring("_l", 20, 1)),
        "_exp": as_digits(s.substr(at + 1, F.lit(6))), "_exp_c": as_digits(s.substr(at + 7, F.lit(1))),
        "_opt": s.substr(at + 8, F.lit(14)), "_opt_c": as_digits(s.substr(at + 22, F.lit(1))),
        "_all_c": as_digits(F.substring("_l", 44, 1)),
        "_sex": s.substr(at, F.lit(1)),
    })
    payload = F.concat("_num", "_num_c", "_dob", "_dob_c", "_exp", "_exp_c", "_opt",
                       F.when(F.col("_opt_c") == "", "0").otherwise(F.col("_opt_c")))
    df = df.withColumns({
        "optional_data": F.replace(F.col("_opt"), F.lit("<"), F.lit("")),
        "_v_num": digit_values(F.col("_num")), "_v_dob": digit_values(F.col("_dob")),
        "_v_exp": digit_values(F.col("_exp")), "_v_opt": digit_values(F.col("_opt")), "_v_all": digit_values(payload),
    })
    df = df.withColumns({
        "_e_num": check_digit_of("_v_num", 9), "_e_dob": check_digit_of("_v_dob", 6),
        "_e_exp": check_digit_of("_v_exp", 6), "_e_all": check_digit_of("_v_all", 39),
    })
    df = df.withColumn("_e_opt", F.when(
        (F.col("optional_data") != "") & F.col("_opt_c").rlike("^[0-9]$"), check_digit_of("_v_opt", 14))
        .otherwise(F.col("_opt_c")))

    def entry(observed, expected):
        return F.struct(F.col(observed).alias("observed"), F.col(expected).alias("expected"),
                        (F.col(observed) == F.col(expected)).alias("valid"))

    pairs = zip(CHECKS, ["_num_c", "_dob_c", "_exp_c", "_opt_c", "_all_c"],
                ["_e_num", "_e_dob", "_e_exp", "_e_opt", "_e_all"])
    checks = F.create_map(*[x for name, o, e in pairs for x in (F.lit(name), entry(o, e))])
    year = F.year(F.lit(as_of).cast("timestamp_ntz")) % 100
    df = df.withColumns({
        "document_number": F.replace(F.col("_num"), F.lit("<"), F.lit("")),
        "nationality": _country(F.substring("_l", 11, 3)),
        "date_of_birth": yymmdd_to_iso(F.col("_dob"), year),
        "date_of_expiry": yymmdd_to_iso(F.col("_exp"), year + 40),
        "sex": F.when(F.col("_sex") == "M", "MALE").when(F.col("_sex") == "F", "FEMALE").when(
            F.col("_l").isNotNull(), "UNSPECIFIED"),
        "checks": F.when(F.col("_l").isNotNull(), checks),
        "all_checks_passed": F.coalesce(
            (F.col("_num_c") == F.col("_e_num")) & (F.col("_dob_c") == F.col("_e_dob"))
            & (F.col("_exp_c") == F.col("_e_exp")) & (F.col("_all_c") == F.col("_e_all")), F.lit(False)),
    })
    return df.withColumn("is_expired", F.coalesce(is_past(F.col("date_of_expiry"), as_of), F.lit(False))).drop(*SCRATCH)


def decode_header(df: DataFrame, line: str) -> DataFrame:
    """Document code, issuer and names of a normalised first line."""
    h = F.when(F.length(line) == LINE, F.col(line))
    parts = F.split(as_letters(h.substr(F.lit(6), F.lit(39))), "<<")

    def part(i):
        return F.trim(F.replace(F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("")), F.lit("<"), F.lit(" ")))

    df = df.withColumns({
        "document_code": F.replace(h.substr(F.lit(1), F.lit(2)), F.lit("<"), F.lit("")),
        "issuing_country": _country(h.substr(F.lit(3), F.lit(3))),
        "surname": F.when(h.isNotNull(), part(1)), "given_names": F.when(h.isNotNull(), part(2)),
    })
    return df.withColumn("full_name", F.when(F.col("given_names") != "", F.trim(
        F.concat_ws(" ", "given_names", "surname"))).otherwise(F.col("surname")))


DECODED = ["parsed", "document_code", "issuing_country", "full_name", "surname", "given_names", "document_number",
           "nationality", "date_of_birth", "sex", "date_of_expiry", "is_expired", "optional_data", "checks",
           "all_checks_passed"]


def order_lines(df: DataFrame, line_a: str, line_b: str) -> DataFrame:
    """Header and data line, swapped when only the second one looks like a header."""
    swap = ~F.coalesce(starts_like_header(F.col(line_a)), F.lit(False)) & F.coalesce(
        starts_like_header(F.col(line_b)), F.lit(False))
    return df.withColumns({
        "header_raw": F.when(swap, F.col(line_b)).otherwise(F.col(line_a)),
        "data_raw": F.when(swap, F.col(line_a)).otherwise(F.col(line_b)),
    })


def decode_td3(df: DataFrame, line_a: str, line_b: str, as_of: str) -> DataFrame:
    """Decode a pair of lines; adds header, data and the DECODED columns."""
    keep = df.columns
    out = order_lines(spread(df), line_a, line_b)
    out = normalise_data(normalise_header(out, "header_raw", "header"), "data_raw", "data")
    out = decode_data(decode_header(out, "header"), "data", as_of)
    ok = (F.length("header") == LINE) & (F.length("data") == LINE)
    blank = {c: F.when(ok, F.col(c)) for c in DECODED[1:-1] if c != "is_expired"}
    out = out.withColumn("parsed", ok).withColumns(blank).withColumns({
        "all_checks_passed": ok & F.col("all_checks_passed"), "is_expired": ok & F.col("is_expired")})
    # a generator fences the chain off: a filter on a decoded column is not rewritten
    # in terms of the raw lines, which would repeat the whole repair chain
    return out.select(*keep, F.inline(F.array(F.struct("header", "data", *DECODED))))


def mrz_state(doc_type: Column, page_type: Column, is_identity_page: Column, n_candidates: Column,
              has_filler_line: Column, parsed: Column, all_passed: Column) -> Column:
    """Six states, first that applies."""
    return (
        F.when((F.upper(page_type) == "PASSPORT_COVER") | ~is_identity_page, "MRZ_INPUT_INSUFFICIENT")
        .when(parsed & all_passed, "MRZ_VALID").when(parsed, "MRZ_INVALID")
        .when((F.upper(doc_type) == "VISA") & ~has_filler_line, "MRZ_NOT_APPLICABLE")
        .when(F.upper(doc_type) == "VISA", "MRZ_UNPARSED")
        .when(n_candidates == 0, "MRZ_NOT_DETECTED").otherwise("MRZ_UNPARSED"))
