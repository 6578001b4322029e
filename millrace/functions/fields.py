"""Fields in long form: which rules a (field, value) breaks, what it is cleaned to, how sure it stays; quick fixes of one field. Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import desk
from millrace.functions.dates import parsed
from millrace.functions.dims import ISO2_TO_ISO3
from millrace.functions.rules import text
from millrace.functions.safety import loose_date
from millrace.functions.text import ambiguity_warnings, lookup, strip_diacritics
from millrace.functions.validators import COUNTRY_CODES, NAME_LETTERS, repair_country

#: What is validated of a document, in this order, by dialect.
DOCUMENT_FIELDS = {
    "service": ("fullName", "surname", "givenName", "passportNumber", "nationality", "dateOfBirth", "expiryDate", "gender", "issuingCountry", "documentType", "idNumber"),
    "util": ("fullName", "surname", "givenName", "passportNumber", "nationality", "dateOfBirth", "expiryDate", "gender", "issuingCountry"),
}
#: Fields of each kind, by dialect.
KINDS = {
    "service": {
        "name": ("fullName", "surname", "givenName", "firstName", "lastName"),
        "passport": ("passportNumber", "documentNumber"),
        "country": ("nationality", "issuingCountry", "countryCode"),
        "birth": ("dateOfBirth",),
        "expiry": ("expiryDate", "idExpiryDate"),
        "gender": ("gender",),
        "document": ("documentType",),
    },
    "util": {
        "name": ("fullName", "surname", "givenName"),
        "passport": ("passportNumber",),
        "country": ("nationality", "issuingCountry"),
        "birth": ("dateOfBirth",),
        "expiry": ("expiryDate",),
        "gender": ("gender",),
        "document": (),
    },
}
#: Codes that are errors; the others are warnings.
ERRORS = ("FIELD_EMPTY", "INVALID_FORMAT", "TOO_SHORT", "INVALID_LENGTH", "INVALID_DATE", "FUTURE_DATE", "EXPIRED", "INVALID_GENDER")
#: Codes that the older dialect does not know as countries, and its letters of names.
LATER_COUNTRIES = ("XOM", "XXA", "XXB", "XXX")
OLDER_LETTERS = "A-Za-zÀ-ÿ\\s'\\-."
SPACES = " \t\n\r\f\v\u00a0\ufeff"


@dataclass(frozen=True)
class Limits:
    """From which confidence a field counts and needs no review, and what corrections and a zone's digits change."""

    least: float = 0.4
    review: float = 0.7
    penalty: float = 0.1
    boost: float = 0.15
    boosted: bool = True
    repair: bool = True


def without_noise(v: Column) -> Column:
    """A name without white space at its ends, without what follows its letters to the end, then without what comes before any."""
    ended = F.regexp_replace(F.btrim(text(v), F.lit(SPACES)), f"\\A([{NAME_LETTERS}]+?)[^{NAME_LETTERS}]+\\z", "$1")
    return F.btrim(F.regexp_replace(F.btrim(ended, F.lit(SPACES)), f"\\A[^{NAME_LETTERS}]+(.+)\\z", "$1"), F.lit(SPACES))


def _later(as_of: str, months: int) -> str:
    """The day so many months on; days that the month lacks run over into the next."""
    d = date.fromisoformat(as_of)
    y, m = divmod(d.month - 1 + months, 12)
    return (date(d.year + y, m + 1, 1) + timedelta(d.day - 1)).isoformat()


def prepared(field: Column, value: Column, dialect: str = "service", limits: Limits = Limits()) -> dict[str, Column]:  # noqa: B008
    """What validated asks for more than once: kind, trimmed, clean (the value that is kept), born and expires (dates of their own kinds)."""
    raw = text(value)
    kind = F.lit("other")
    for name, fields in KINDS[dialect].items():
        kind = F.when(field.isin(*fields), name).otherwise(kind) if fields else kind
    trimmed = F.btrim(raw, F.lit(SPACES))
    bare = F.replace(F.upper(trimmed), F.lit("<"), F.lit(""))
    known = bare.isin(*COUNTRY_CODES)
    found = F.when(known, bare).otherwise(repair_country(bare)) if limits.repair else F.when(known, bare)
    country = F.when(F.length(bare) == 3, F.coalesce(found, raw)).otherwise(raw)
    services = {"name": without_noise(raw), "passport": F.when(bare != "", bare).otherwise(raw), "country": country}
    clean = reduce(lambda c, p: F.when(field.isin(*KINDS["service"][p[0]]), p[1]).otherwise(c), services.items(), raw) if dialect == "service" else raw
    dates = {n: F.when(field.isin(*KINDS[dialect][n]), parsed(raw)) for n in ("birth", "expiry")}
    return {"kind": kind, "trimmed": trimmed, "clean": clean, "born": dates["birth"], "expires": dates["expiry"]}


def validated(field: Column, value: Column, confidence: Column, as_of: str, corrected: Column | None = None, digits_passed: Column | None = None, zone_valid: Column | None = None, dialect: str = "service", limits: Limits = Limits(), ready: dict[str, Column] | None = None) -> Column:  # noqa: B008
    """field, value, confidence, adjusted, raw, other, corrected, repaired_from, issues of one field, in the rules' order.

    dialect service cleans names and numbers and repairs countries; util, the older one, takes values as they are,
    knows neither the sex X nor types of documents, tells ages by the years alone, calls every name fullName, and
    adds a valid zone's boost before the rules and not after them. Fields of no kind are valid if they have a
    character. Null counts as empty; as_of is the start of its day. ready: prepared's columns where they are
    projected already, so that each is computed once.
    """
    no = F.lit(False)
    corrected, passed, zone = (no if c is None else F.coalesce(c, no) for c in (corrected, digits_passed, zone_valid))
    raw, service = text(value), dialect == "service"
    ready = ready or prepared(field, value, dialect, limits)
    kind, trimmed, clean, born, expires = (ready[n] for n in ("kind", "trimmed", "clean", "born", "expires"))
    is_name, is_passport, is_country, is_birth, is_expiry, is_gender, is_document = (kind == k for k in KINDS["service"])
    filled = trimmed != ""
    blank = (kind != "other") & ~filled
    now, soon = (F.lit(d).cast("date") for d in (as_of, _later(as_of, 3)))
    age = F.year(now) - F.year(born)
    if service:
        early = F.month(born) * 100 + F.dayofmonth(born) > F.month(now) * 100 + F.dayofmonth(now)
        age = age - early.cast("int")
        code = F.replace(F.upper(trimmed), F.lit("<"), F.lit(""))
        number = code
        sized = is_country & filled & (F.length(code) == 3)
        known = sized & code.isin(*COUNTRY_CODES)
        better = sized & ~known & clean.isin(*COUNTRY_CODES)
        repaired = F.when(better, code).when(is_country & (clean != raw), raw)
        letters, number_fits, genders = NAME_LETTERS, number.rlike(r"\A[A-Z0-9]{5,20}\z"), ("M", "F", "X", "UNKNOWN")
    else:
        code, number, repaired, better = raw, raw, F.lit(None).cast("string"), no
        sized = is_country & filled & (F.length(code) == 3)
        known = F.upper(code).isin(*[c for c in COUNTRY_CODES if c not in LATER_COUNTRIES])
        letters, number_fits, genders = OLDER_LETTERS, number.rlike(r"\A[A-Z0-9<]{5,20}\z"), ("M", "F", "UNKNOWN")
    tests = (
        (blank, "FIELD_EMPTY"),
        (filled & ((is_name & ~clean.rlike(f"\\A[{letters}]+\\z")) | (is_passport & ~number_fits)), "INVALID_FORMAT"),
        *([(is_name & (clean != raw) & (clean != ""), "TRAILING_OCR_NOISE"), (is_passport & (number != raw), "PASSPORT_NORMALIZED")] if service else []),
        (is_name & (F.length(raw) > 100), "TOO_LONG"),
        (is_passport & number.rlike("[OIL]"), "AMBIGUOUS_CHARS"),
        *([(is_passport & F.length(number).between(1, 4), "TOO_SHORT")] if service else []),
        (is_country & filled & (F.length(code) != 3), "INVALID_LENGTH"),
        *([(better, "COUNTRY_CODE_REPAIRED")] if service else []),
        (sized & ~known & ~better, "UNRECOGNIZED_COUNTRY"),
        (filled & ((is_birth & born.isNull()) | (is_expiry & expires.isNull())), "INVALID_DATE"),
        (born > now, "FUTURE_DATE"),
        (born < F.lit("1900-01-01").cast("date"), "UNUSUALLY_OLD"),
        ((age < 0) | (age > 120), "UNUSUAL_AGE"),
        (expires < now, "EXPIRED"),
        ((expires >= now) & (expires < soon), "EXPIRING_SOON"),
        (expires > F.lit("2100-01-01").cast("date"), "UNUSUAL_EXPIRY"),
        (is_gender & filled & ~raw.isin(*genders), "INVALID_GENDER"),
        (is_gender & (raw == "UNKNOWN"), "GENDER_UNKNOWN"),
        (is_document & filled & ~raw.isin("PASSPORT", "ID_CARD", "UNKNOWN"), "UNSUPPORTED_TYPE"),
    )
    # array_except drops the nulls within generated code, which higher-order functions leave.
    issues = F.array_except(F.array(*[F.when(test, F.lit(code)) for test, code in tests]), F.array(F.lit(None).cast("string")))
    fixed = corrected | repaired.isNotNull()

    def lowered(c: Column) -> Column:
        return F.when(fixed, F.greatest(F.lit(0.0), c - limits.penalty)).otherwise(c)

    def raised(c: Column, by: float) -> Column:
        return F.least(F.lit(1.0), c + by)

    if service:
        given, first = confidence, lowered(confidence)
        boosted = F.when(passed, raised(first, limits.boost) if limits.boosted else first).when(zone, raised(first, limits.boost / 2)).otherwise(first)
    else:
        given = F.when(zone & (kind != "other"), raised(confidence, limits.boost)).otherwise(confidence) if limits.boosted else confidence
        boosted = lowered(given)
    other = kind == "other"
    adjusted = F.when(other, confidence).otherwise(boosted)
    return F.struct(
        (field if service else F.when(is_name, "fullName").otherwise(field)).alias("field"), clean.alias("value"), given.alias("confidence"), adjusted.alias("adjusted"), raw.alias("raw"),
        other.alias("other"), fixed.alias("corrected"), repaired.alias("repaired_from"), issues.alias("issues"),
    )


def judged(v: Column, limits: Limits = Limits()) -> tuple[Column, Column]:  # noqa: B008
    """Whether what validated gives is valid, and whether it needs review."""
    bad = F.arrays_overlap(v["issues"], F.array(*map(F.lit, ERRORS)))
    valid = F.when(v["other"], v["raw"] != "").otherwise(~bad & (v["adjusted"] >= limits.least))
    return valid, ~v["other"] & (bad | (v["adjusted"] < limits.review))


FIX = "array<struct<action:string,code:string,value:string>>"


def quick_fixes(field: Column, value: Column, nationality: Column, as_of: str, most: int = 5) -> Column:
    """What a reviewer may do about a field, the first five as (action, code, value): review, or replace by value.

    Numbers: placeholders, formats of other countries (passports only), each character that may be misread with
    each that it may stand for. Names: too short ones, digits. Dates of birth: ages under 1 or over 120, other
    layouts. Sexes in words, two-letter countries. Other and empty fields have none.
    """
    v, code = text(value), F.upper(text(value))

    def fix(test: Column, action: str, name: str, new: Column | None = None) -> Column:
        row = F.struct(F.lit(action).alias("action"), F.lit(name).alias("code"), (F.lit(None) if new is None else new).cast("string").alias("value"))
        return F.when(F.coalesce(test, F.lit(False)), row)

    def rows(*fixes: Column) -> Column:
        return F.array_compact(F.array(*fixes))

    # Every ambiguous character has a suggestion other than itself, so the first warnings give the first fixes; no more are written out.
    swaps = F.flatten(
        F.transform(
            F.slice(ambiguity_warnings(v), 1, most),
            lambda w: F.transform(
                F.filter(F.split(w["suggestions"], ","), lambda s: s != w["char"]),
                lambda s: F.struct(F.lit("replace").alias("action"), F.lit("AMBIGUOUS_CHARACTER").alias("code"), F.concat(F.substr(v, F.lit(1), w["position"]), s, F.substr(v, w["position"] + 2)).alias("value")),
            ),
        )
    )
    foreign = (field == "passportNumber") & (text(nationality) != "") & ~desk.passport_fits(v, nationality)
    numbers = F.concat(rows(fix(desk.whole(v, "0+"), "review", "PLACEHOLDER_NUMBER"), fix(foreign, "review", "COUNTRY_FORMAT")), swaps)
    n, digits = F.length(v), v.rlike("[0-9]")
    names = rows(fix(n == 1, "review", "NAME_TOO_SHORT"), fix(n == 2, "review", "NAME_MAY_BE_CUT"), fix(digits, "replace", "DIGITS_IN_NAME", F.btrim(F.regexp_replace(v, "[0-9]", ""), F.lit(SPACES))))
    born = loose_date(v)
    age = F.lit(int(as_of[:4])) - F.year(born)

    def part(at: int, size: int) -> Column:
        return F.substring(v, at, size)

    dates = rows(
        fix((age < 1) | (age > 120), "review", "AGE_OUT_OF_RANGE"),
        fix(born.isNull() & desk.whole(v, "[0-9]{8}"), "replace", "COMPACT_DATE", F.concat_ws("/", part(7, 2), part(5, 2), part(1, 4))),
        fix(born.isNull() & desk.whole(v, "[0-9]{2}/[0-9]{2}/[0-9]{4}"), "replace", "DAY_FIRST", F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2))),
    )
    sexes = rows(fix(code == "MALE", "replace", "SEX_IN_WORDS", F.lit("M")), fix(code == "FEMALE", "replace", "SEX_IN_WORDS", F.lit("F")))
    three = lookup(ISO2_TO_ISO3, code, F.lit(None).cast("string"))
    nations = rows(fix((n == 2) & three.isNotNull(), "replace", "TWO_LETTER_COUNTRY", three))
    found = F.when(v == "", F.array().cast(FIX)).when(field.isin("passportNumber", "idNumber"), numbers).when(field.isin("fullName", "surname", "givenName"), names)
    found = found.when(field == "dateOfBirth", dates).when(field == "gender", sexes).when(field == "nationality", nations).otherwise(F.array().cast(FIX))
    return F.slice(found, 1, most)


def further_advice(record: dict[str, Column], as_of: str) -> Column:
    """(field, priority, code) that fields give together, all of high priority, in the rules' order.

    record: fullName, surname, givenName, passportNumber, nationality, issuingCountry, dateOfBirth,
    passportExpiryDate, gender and likelyGender (M, F, or null: what the name suggests). Fields that are null or
    empty give no advice. The validity is the days from birth to expiry over 365.25.
    """
    f = {k: text(record.get(k, F.lit(None).cast("string"))) for k in ("fullName", "surname", "givenName", "passportNumber", "nationality", "issuingCountry", "gender", "likelyGender")}
    born, expires = loose_date(record["dateOfBirth"]), loose_date(record["passportExpiryDate"])
    nation, issuer = f["nationality"], f["issuingCountry"]
    plain = {k: strip_diacritics(F.lower(f[k])) for k in ("fullName", "surname", "givenName")}
    years = F.datediff(expires, born) / 365.25
    tests = (
        ((f["passportNumber"] != "") & (nation != "") & ~desk.passport_fits(f["passportNumber"], nation), "passportNumber", "COUNTRY_FORMAT"),
        ((nation != "") & (issuer != "") & (lookup(ISO2_TO_ISO3, nation, nation) != lookup(ISO2_TO_ISO3, issuer, issuer)), "nationality", "COUNTRY_MISMATCH"),
        (
            (plain["fullName"] != "") & (plain["surname"] != "") & (plain["givenName"] != "") & ~plain["fullName"].contains(plain["surname"]) & ~plain["fullName"].contains(plain["givenName"]),
            "cross-field", "NAME_MISMATCH",
        ),
        (expires <= born, "dateOfBirth", "EXPIRY_BEFORE_BIRTH"),
        (F.year(expires) - F.year(born) > 100, "passportNumber", "AGE_AT_EXPIRY"),
        ((f["fullName"] != "") & ~f["gender"].isin("", "UNKNOWN") & f["likelyGender"].isin("M", "F") & (f["likelyGender"] != f["gender"]), "gender", "GENDER_MISMATCH"),
        ((years > 100) | (years < 15), "dateOfBirth", "IMPLAUSIBLE_VALIDITY"),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(name).alias("field"), F.lit("high").alias("priority"), F.lit(c).alias("code"))) for t, name, c in tests]))
