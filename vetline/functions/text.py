"""Text normalisation, label-noise tests, masks and field equality as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide which text counts as missing, as a label or as equal.
MISSING_SERVER = ["UNKNOWN", "NOT_AVAILABLE", "NOT_FOUND", "N/A", "NONE", "NULL"]
MISSING_DATE = ["UNKNOWN", "NOT_AVAILABLE", "NOT_FOUND", "N/A", "NONE"]
MISSING_DISPLAY = ["", "—", "-", "None", "null", "undefined"]

LABEL_PREFIXES = [
    r"^(?:SURNAME/NOM|GIVEN NAMES/PRÉNOMS|FULL NAME|HOLDER NAME|NAME|NOM)\s*[:./\-]*\s*",
    r"^(?:S/O|D/O|W/O)\s*",
    r"^(?:SEX/SEXE)\s*[:./\-]*\s*",
    r"^(?:DATE OF BIRTH/DATE DE NAISS|DATE OF BIRTH|DOB)\s*[:./\-]*\s*",
    r"^(?:NATIONALITY|NATIONALITÉ)\s*[:./\-]*\s*",
    r"^(?:PASSPORT NO\./NO\. PASSEPORT|PASSPORT NO|PPT NO)\s*[:./\-]*\s*",
    r"^(?:VISA NO\./NO\. VISA|VISA NO|VISA NUMBER)\s*[:./\-]*\s*",
    r"^(?:VALID FROM/VALIDE DU|VALID FROM)\s*[:./\-]*\s*",
    r"^(?:VALID UNTIL/VALIDE JUSQU'AU|VALID UNTIL|EXPIRY DATE)\s*[:./\-]*\s*",
    r"^(?:ENTRIES/ENTRÉES|ENTRIES)\s*[:./\-]*\s*",
    r"^(?:DURATION OF STAY/DURÉE DU SÉJOUR|DURATION OF STAY)\s*[:./\-]*\s*",
]

LABEL_WORDS_VISA = (
    "SURNAME NOM NOW GIVEN NAMES NAWES PRENOM PRENOMS PRENOW PRENOUS PRENOWS NAME FULL HOLDER PASSPORT PASSEPORT "
    "VISA VIZUM VIGNETTE REPUBLIC OF COUNTRY TYPE CATEGORY NATIONALITY NATIONALITE SEX SEXE GENDER DATE BIRTH "
    "NAISSANCE EXPIRY VALID UNTIL FROM ENTRIES DURATION STAY PLACE ISSUE MAT MATRICULE SIGNATURE TITULAIRE OFFICER "
    "REMARKS REMARQUES CONFERENCE ATTENDANCE PERMITTED GIVENNAMES FULLNAME MATNOM SURNAMENOM PASSPORTNO DOCUMENTNO "
    "EXPIRATION VALIDITY DELIVRANCE DELIVERY AUTORITE AUTHORITY BEARER PAYS CODE ISSUING POST DELHI INDIA ISLANDS"
).split()
LABEL_WORDS_READER = (
    "SURNAME NOM NOW GIVEN NAMES NAWES PRENOM PRENOMS PRENOW PRENOUS PRENOWS NAME FULL HOLDER PASSPORT PASSEPORT "
    "REPUBLIC INDIA TYPE COUNTRY CODE PAYS NATIONALITY NATIONALITE SEX SEXE GENDER DATE BIRTH EXPIRY ISSUE PLACE LIEU "
    "DELIVERY DELWRANCE DELIVRANCE NAISSANCE NASSANGE NAISEANCE ZE EA MAT MATRICULE SIGNATURE TITULAIRE OFFICER VISA "
    "VIGNETTE GIVENNAMES FULLNAME MATNOM SURNAMENOM PASSPORTNO DOCUMENTNO EXPIRATION VALIDITY AUTORITE AUTHORITY "
    "BEARER DELHI"
).split()
BOILERPLATE_WORDS = (
    "INDIA PASSPORT REPUBLIC PAGE COVER OBSERVATION CITIZEN GOVERNMENT MINISTRY WORLD FAMILY HOLDER PROSPEROUS SAFER"
).split()
LABEL_WORDS_DISPLAY = (
    "NOM SURNAME PRENOM PRENOMS GIVEN GIVENNAMES NAME FULLNAME MAT MATRICULE HOLDER SIGNATURE OFFICER PASSPORT "
    "PASSPORTNO DOCUMENT DOCUMENTNO VISA VIGNETTE NATIONALITY CITIZENSHIP SEX DATEOFBIRTH DOB EXPIRY EXPIRATION "
    "VALIDITY OF NO NR NUM BIRTH MATNOM SURNAMENOM DELIVRANCE DELIVERY AUTORITE AUTHORITY BEARER PAYS"
).split()
LABEL_PATTERNS_DISPLAY = [
    r"(?i)^(?:SURNAME|NOM|GIVEN\s*NAMES?|PRENOMS?|FULL\s*NAME|NAME|HOLDER|OF\s*HOLDER)[\s:./\-_]*$",
    r"(?i)^(?:MAT(?:RICULE)?[\s:./\-_]*(?:NOM)?|ME\s*INOM|MAT\s*/NOM[\s:.]*|NOM[\s:.]*|PRENOM[\s:.]*)$",
    r"(?i)^(?:PASSPORT|PASSPORT\s*NO|DOCUMENT\s*NO|DOC\s*NO|VISA\s*NO|VIGNETTE\s*NO)[\s:./\-_]*$",
    r"(?i)^(?:COUNTRY|NATIONALITY|CITIZENSHIP|SEX|GENDER|DATE\s*OF\s*BIRTH|DOB|DATE\s*OF\s*EXPIRY|EXPIRY)[\s:./\-_]*$",
    r"(?i)^(?:TYPE|CATEGORY|ENTRIES|VALID\s*FROM|VALID\s*UNTIL|ISSUING\s*POST|PLACE\s*OF\s*ISSUE)[\s:./\-_]*$",
    r"(?i)^(?:SIGNATURE|OFFICER|BEARER|AUTORITE|AUTHORITY|REPUBLIC|GOVERNMENT)[\s:./\-_]*$",
    r"(?i)^(/NOM|MAT\s*/|ME\s*INOM|MATRICULE)",
]
NAME_LABEL_PREFIX = r"(?i)^(?:SURNAME|NOM|GIVEN|NAMES|PRENOM|PRENOMS|MAT|MATRICULE|NAME|FULL)[\s:./\-]+"
DEMONYMS = {
    "IND": "INDIAN", "1ND": "INDIAN", "INDIAN": "INDIAN", "USA": "AMERICAN", "AMERICAN": "AMERICAN",
    "GBR": "BRITISH", "BRITISH": "BRITISH", "FRA": "FRENCH", "FRENCH": "FRENCH", "AUS": "AUSTRALIAN",
    "AUSTRALIAN": "AUSTRALIAN", "CAN": "CANADIAN", "CANADIAN": "CANADIAN", "DEU": "GERMAN", "GERMAN": "GERMAN",
}
SEX_CODES = {"M": "M", "MALE": "M", "F": "F", "FEMALE": "F"}


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values) -> str:
    return ", ".join(map(_quoted, values))


def words(values) -> Column:
    """A constant array, parsed in one go instead of built literal by literal."""
    return F.expr(f"array({_list(values)})")


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a small constant dictionary, null when the key is not in it."""
    return F.try_element_at(F.expr("map(" + ", ".join(_quoted(x) for kv in mapping.items() for x in kv) + ")"), key)


def let(value: Column, body) -> Column:
    """``body`` applied to a value that is computed once, for use inside longer expressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def each(values: list[Column], body: str) -> Column:
    """Array of ``body``, a lambda in SQL text, applied to every value. A long body costs one parse
    here, where built call by call it costs many trips to the JVM before the job starts."""
    return F.call_function("transform", F.array(*values), F.expr(body))


def let_sql(value: Column, body: str) -> Column:
    """``let`` with a lambda in SQL text."""
    return F.element_at(each([value], body), 1)


def _let_text(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def denull(c: Column, missing=tuple(MISSING_SERVER)) -> Column:
    """Null for placeholders, whatever their case; otherwise the trimmed text."""
    return let(F.trim(c), lambda t: F.when((t != "") & ~F.upper(t).isin(*missing), t))


def denull_display(c: Column) -> Column:
    """Null for the placeholders a display shows, case-sensitive."""
    return let(F.trim(c), lambda t: F.when(~t.isin(*MISSING_DISPLAY), t))


def normalize_text(c: Column) -> Column:
    """Upper case, filler to blank, known label prefixes off, blanks collapsed, empty to null."""
    upper = F.upper(F.replace(denull(c), F.lit("<"), F.lit(" ")))
    bare = reduce(lambda acc, pattern: F.regexp_replace(acc, pattern, ""), LABEL_PREFIXES, upper)
    return F.nullif(squeeze(bare), F.lit(""))


def alpha_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.upper(c), F.lit("[A-Z]+"), F.lit(0))


#: SQL for the upper-case words of the text ``t``.
_TOKENS = "regexp_extract_all(upper(t), '[A-Z]+', 0)"


def noise_text(c: str, variant: str = "visa") -> str:
    """SQL for whether the SQL value ``c`` is only printed labels. Variants: visa, reader, display."""
    if variant == "display":
        labels = _list(LABEL_WORDS_DISPLAY)
        patterns = "(?i)" + "|".join(p.removeprefix("(?i)") for p in LABEL_PATTERNS_DISPLAY)
        first = f"when t rlike r'{patterns}' then true "
        then = f"when upper(regexp_replace(t, '[^A-Za-z]', '')) in ({labels}) then true "
        judge = f"size(w) > 0 and size(array_except(filter(w, x -> length(x) > 1), array({labels}))) = 0"
    else:
        labels = LABEL_WORDS_VISA if variant == "visa" else LABEL_WORDS_READER
        first = then = ""
        judge = f"size(w) = 0 or size(array_except(w, array({_list(labels)}))) = 0"
        if variant == "reader":
            judge += f" or size(w) > 3 or arrays_overlap(w, array({_list(BOILERPLATE_WORDS)}))"
    return _let_text(f"trim(coalesce({c}, ''))", "t", f"case when length(t) < 2 then true {first}"
                     rf"when t rlike r'\d{{3,}}' then false {then}else {_let_text(_TOKENS, 'w', judge)} end")


def is_label_noise(c: Column, variant: str = "visa") -> Column:
    """Whether a candidate value is only printed labels. Variants: visa, reader, display."""
    return let_sql(c, f"c -> {noise_text('c', variant)}")


def display_noise_text(c: str, field: str) -> str:
    """The display variant with its exceptions for document type and sex values, as SQL."""
    keep = {"document_type": ["PASSPORT", "VISA", "ID", "P", "V", "TRAVELDOCUMENT"],
            "sex": ["M", "F", "MALE", "FEMALE"]}
    alias = {"doc_type": "document_type", "type": "document_type", "gender": "sex"}
    allowed = keep.get(alias.get(field, field))
    noise = noise_text(c, "display")
    folded = f"upper(regexp_replace(coalesce({c}, ''), '[^A-Za-z]', ''))"
    return f"case when {folded} in ({_list(allowed)}) then false else {noise} end" if allowed else noise


def shown_text(field: str) -> str:
    """SQL lambda: the value a display would show, null for placeholders and labels."""
    return "c -> " + _let_text("trim(c)", "s", f"case when s not in ({_list(MISSING_DISPLAY)}) and not ({display_noise_text('s', field)}) then s end")


def clean_name_tokens(c: Column, variant: str = "visa") -> Column:
    """Name words of a candidate line, '' when nothing but labels is left."""
    return let_sql(c, clean_names_text(variant))


def clean_names_text(variant: str = "visa") -> str:
    """SQL lambda of ``clean_name_tokens``."""
    labels = _list(LABEL_WORDS_VISA if variant == "visa" else LABEL_WORDS_READER)
    bare = f"regexp_replace(trim(coalesce(c, '')), r'{NAME_LABEL_PREFIX}', '')"
    tokens = rf"split(upper(trim(regexp_replace(regexp_replace({bare}, '[^A-Za-z]', ' '), r'\s+', ' '))), ' ')"
    good = f"filter({tokens}, x -> length(x) >= 2 and x not in ({labels}) and (length(x) > 2 or x rlike '[AEIOUY]'))"
    return "c -> " + _let_text(f"array_join({good}, ' ')", "n", f"case when {noise_text('n', variant)} then '' else n end")


def full_name(given: Column, surname: Column) -> Column:
    """'GIVEN SURNAME', null when both parts are missing or empty."""
    return F.nullif(F.trim(F.concat_ws(" ", F.nullif(given, F.lit("")), F.nullif(surname, F.lit("")))), F.lit(""))


def title_label(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def strip_identifier(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9_-]", ""))


def fold_number(c: Column) -> Column:
    """Document number for lookups: no blanks, upper case."""
    return F.upper(F.replace(c, F.lit(" "), F.lit("")))


def valid_identifier(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("^[A-Za-z0-9_-]{3,64}$"), F.lit(False))


def sanitize_filename(c: Column) -> Column:
    base = F.trim(F.substring_index(c, "/", -1))
    clean = F.regexp_replace(base, "[^a-zA-Z0-9_.-]", "_")
    return F.when(clean == "", F.lit("upload.jpg")).otherwise(clean)


# -- token sets ---------------------------------------------------------------

def token_set(c: Column) -> Column:
    return F.array_distinct(alpha_tokens(c))


def same_tokens(a: Column, b: Column) -> Column:
    ta, tb = token_set(a), token_set(b)
    return (F.size(ta) > 0) & (F.size(F.array_except(ta, tb)) == 0) & (F.size(F.array_except(tb, ta)) == 0)


def any_token_shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(token_set(a), token_set(b))) > 0


def token_overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set; null when a side has none."""
    ta, tb = token_set(a), token_set(b)
    larger = F.greatest(F.size(ta), F.size(tb))
    return F.when((F.size(ta) > 0) & (F.size(tb) > 0), F.size(F.array_intersect(ta, tb)) / larger)


# -- masks --------------------------------------------------------------------

def mask_number(c: Column) -> Column:
    """First three and last two characters stay."""
    t = F.trim(c)
    n = F.length(t)
    hidden = F.when(n > 5, F.repeat(F.lit("*"), n - 5)).otherwise(F.lit("**"))
    return (F.when(c.isNull() | (c == ""), F.lit("N/A")).when(n <= 4, F.lit("****"))
            .otherwise(F.concat(F.left(t, F.lit(3)), hidden, F.right(t, F.lit(2)))))


def _mask_words(c: Column, mask_one) -> Column:
    return F.array_join(F.transform(F.split(squeeze(c), " "), mask_one), " ")


def mask_name(c: Column) -> Column:
    """First and last letter of every word stay; one star after words of one or two letters."""
    def one(w):
        inner = F.repeat(F.lit("*"), F.greatest(F.length(w) - 2, F.lit(1)))
        return F.when(F.length(w) <= 2, F.concat(F.left(w, F.lit(1)), F.lit("*"))).otherwise(
            F.concat(F.left(w, F.lit(1)), inner, F.right(w, F.lit(1))))
    return F.when(c.isNull() | (c == ""), F.lit("ANONYMOUS")).otherwise(_mask_words(c, one))


def mask_birth_date(c: Column) -> Column:
    year = F.regexp_extract(F.trim(c), r"^(\d{4})[-/.]\d{2}[-/.]\d{2}$", 1)
    return (F.when(c.isNull() | (c == ""), F.lit("N/A")).when(year != "", F.concat(year, F.lit("-**-**")))
            .otherwise(F.lit("****-**-**")))


def mask_export(field: Column, c: Column) -> Column:
    """Masks for exported results, by field name; other fields and placeholders pass."""
    t = F.trim(c)
    n = F.length(t)
    name = _mask_words(t, lambda w: F.concat(F.left(w, F.lit(1)),
                                             F.repeat(F.lit("*"), F.greatest(F.length(w) - 1, F.lit(1)))))
    number = F.when(n > 3, F.concat(F.left(t, F.lit(2)), F.repeat(F.lit("*"), n - 3), F.right(t, F.lit(1)))).otherwise(
        F.concat(F.left(t, F.lit(1)), F.repeat(F.lit("*"), n - 1)))
    birth = F.when(n >= 4, F.concat(F.left(t, F.lit(4)), F.lit("-**-**"))).otherwise(F.lit("****-**-**"))
    return (F.when((t == "") | F.upper(t).isin("UNKNOWN", "NONE", "NULL"), t)
            .when(field.isin("name", "surname", "given_names", "holder_name"), name)
            .when(field.isin("passport_number", "visa_number"), number)
            .when(field == "date_of_birth", birth).otherwise(t))
