"""Unit vectors of the column functions."""

import pytest
from pyspark.sql import functions as F

from vetline.functions import dates, fields, mrz, text

AS_OF = "2026-07-01 12:00:00"
L1 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"


def digit(text):
    return str(sum((int(c, 36) if c != "<" else 0) * (7, 3, 1)[i % 3] for i, c in enumerate(text)) % 10)


def data_line(number="L898902C3", birth="740812", expiry="120415", optional="ZA184226B<<<<<"):
    body = number + digit(number) + birth + digit(birth) + expiry + digit(expiry) + optional + digit(optional)
    return (number + digit(number) + "UTO" + birth + digit(birth) + "F" + expiry + digit(expiry) + optional
            + digit(optional) + digit(body))


L2 = data_line()


def one(spark, column, value, *more):
    df = spark.createDataFrame([(value, *more)], ", ".join(f"c{i} string" for i in range(1 + len(more))))
    return df.select(column(*[F.col(c) for c in df.columns]).alias("x")).first()["x"]


@pytest.mark.parametrize("data,digit", [("L898902C3", "6"), ("740812", "2"), ("120415", "9"), ("", "0"), ("<<<<", "0")])
def test_check_digit(spark, data, digit):
    assert one(spark, mrz.check_digit, data) == digit
    if data:
        df = spark.createDataFrame([(data,)], "d string").select(mrz.digit_values(F.col("d")).alias("v"))
        assert df.select(mrz.check_digit_of("v", len(data)).alias("x")).first()["x"] == digit


def decode(spark, a, b):
    return mrz.decode_td3(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b", AS_OF).first()


def test_specimen_is_decoded(spark):
    r = decode(spark, L1, L2)
    assert r["parsed"] and r["all_checks_passed"]
    assert (r["surname"], r["given_names"], r["full_name"]) == ("ERIKSSON", "ANNA MARIA", "ANNA MARIA ERIKSSON")
    assert (r["document_number"], r["date_of_birth"], r["sex"], r["date_of_expiry"]) == (
        "L898902C3", "1974-08-12", "FEMALE", "2012-04-15")
    assert r["is_expired"] and r["optional_data"] == "ZA184226B"


@pytest.mark.parametrize("a,b,ok", [
    (L2, L1, True),                                  # swapped lines
    ("noise " + L1.lower(), L2, True),               # lower case, text before the header
    (L1.replace("ANNA<MARIA", "ANNA MARIA"), L2, True),  # a blank for filler
    (L1[:40], L2, True), (L1[:30], L2, False),       # padded from 35 characters, not below
    (L1, L2[:2] + "0" + L2[3:], False),              # one digit of the number changed
    (L1, L2[:13] + "7408I2" + L2[19:], True),        # letter read for a digit
])
def test_repairs(spark, a, b, ok):
    r = decode(spark, a, b)
    assert r["all_checks_passed"] == ok


def test_filler_letters_of_the_optional_zone_count_as_noise(spark):
    """E, K, X and C are read as filler there, so an optional number that holds one fails."""
    assert not decode(spark, L1, data_line(optional="ZE184226B<<<<<"))["all_checks_passed"]


def test_one_changed_digit_fails_its_check_and_the_composite(spark):
    r = decode(spark, L1, L2[:14] + "5" + L2[15:])
    assert {k for k, v in r["checks"].items() if not v["valid"]} == {"date_of_birth", "composite"}


def test_header_repairs(spark):
    got = mrz.normalise_header(spark.createDataFrame([("P<1NDDOE<<JOHNK<<<<<KEXC<<<<<<<<<<<<<<<<<<",)], "a string"),
                               "a", "h").first()["h"]
    assert got == "P<INDDOE<<JOHN".ljust(44, "<")


@pytest.mark.parametrize("value,lenient,strict,visa,display", [
    ("2026-02-30", "2026-02-30", None, None, None),
    ("12 dec 2000", "2000-12-12", "2000-12-12", "2000-12-12", "2000-12-12"),
    ("15-OCT-2006", "2006-10-15", None, "2006-10-15", None),
    ("5/3/1990", "1990-03-05", "1990-03-05", "1990-03-05", "1990-03-05"),
    ("1.2.2001", "2001-02-01", None, "2001-02-01", "2001-02-01"),
    ("460101", "1946-01-01", None, None, "2046-01-01"),
    ("DOB: 01/02/1999", "1999-02-01", None, None, None),
    ("3 March 2011", "2011-03-03", "2011-03-03", "2011-03-03", "2011-03-03"),
    ("hello", "HELLO", None, None, None), ("N/A", None, None, None, None)])
def test_date_readers_differ(spark, value, lenient, strict, visa, display):
    got = [one(spark, f, value) for f in (dates.normalize_date, dates.strict_date, dates.visa_date, dates.display_date)]
    assert got == [lenient, strict, visa, display]


def test_expiry_counts_from_midnight(spark):
    assert one(spark, lambda c: dates.is_past(c, AS_OF), "2026-07-01") is True
    assert one(spark, lambda c: dates.is_past(c, AS_OF), "2026-07-02") is False


@pytest.mark.parametrize("value,visa,reader,display", [
    ("SURNAME", True, True, True), ("Surname / Nom", True, True, True), ("X", True, True, True),
    ("DOE", False, False, False), ("REPUBLIC DOE", False, True, False), ("PASSPORT 123456", False, False, False),
    ("ONE TWO THREE FOUR", False, True, False), ("Visa", True, True, True), ("12 3", True, True, False)])
def test_label_noise(spark, value, visa, reader, display):
    got = [one(spark, lambda c, v=v: text.is_label_noise(c, v), value) for v in ("visa", "reader", "display")]
    assert got[:2] == [visa, reader]
    assert got[2] == display


@pytest.mark.parametrize("fn,value,want", [
    (text.mask_number, "Z1234567", "Z12***67"), (text.mask_number, "Z123", "****"), (text.mask_number, None, "N/A"),
    (text.mask_number, "Z1234", "Z12**34"), (text.mask_name, "ARJUN SHARMA", "A***N S****A"),
    (text.mask_name, "AL X", "A* X*"), (text.mask_birth_date, "1990-05-12", "1990-**-**"),
    (text.mask_birth_date, "12 May", "****-**-**"), (text.normalize_text, "SURNAME/NOM: DOE<<JOHN", "DOE JOHN"),
    (text.normalize_text, " n/a ", None), (text.clean_name_tokens, "GIVEN NAMES: dk Ravi of", "RAVI"),
    (text.sanitize_filename, "../../etc/pass wd.png", "pass_wd.png"), (text.sanitize_filename, "a/", "upload.jpg"),
    (text.strip_identifier, " z-1.2_3 ", "Z-12_3"), (text.title_label, "date_of_birth", "Date Of Birth")])
def test_text(spark, fn, value, want):
    assert one(spark, fn, value) == want


@pytest.mark.parametrize("field,a,b,want", [
    ("name", "NEGI RAM", "RAM NEGI", "MATCH"), ("nationality", "IND", "INDIAN", "MATCH"), ("sex", "M", "MALE", "MATCH"),
    ("sex", "M", "F", "MISMATCH"), ("passport_number", "Z1", None, "UNKNOWN"), ("nationality", "XXX", "YYY", "MISMATCH")])
def test_compare_status(spark, field, a, b, want):
    assert one(spark, lambda x, y: fields.compare_status(field, x, y), a, b) == want


@pytest.mark.parametrize("field,a,b,record,display", [
    ("full_name", "RAM KUMAR NEGI", "NEGI RAM", False, False), ("full_name", "A RAM NEGI", "NEGI RAM", False, True),
    ("document_number", "Z 12-34", "Z1234", True, True), ("date_of_birth", "01/02/1999", "1999-02-01", True, True),
    ("surname", "NEG", "NEGI", False, True), ("document_type", "PASSPORT", "P", True, True)])
def test_record_and_display_equality(spark, field, a, b, record, display):
    assert one(spark, lambda x, y: fields.record_equal(field, x, y), a, b) == record
    assert one(spark, lambda x, y: fields.display_equal(field, x, y), a, b) == display


@pytest.mark.parametrize("value,shown", [("BEARER", None), ("Bearer:", None), ("BEARER AAAOEN", "BEARER AAAOEN"), ("BEARERS", "BEARERS")])
def test_a_display_hides_a_name_that_is_a_printed_label(spark, value, shown):
    """As the display of the reference does, whichever reading the value comes from."""
    assert one(spark, lambda c: fields.usable(c, "given_names"), value) == shown
