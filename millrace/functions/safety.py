"""Before a record is used: accuracy of its fields, blended with the recogniser's confidence, named checks, warnings of validated fields. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import desk
from millrace.functions.dates import parsed
from millrace.functions.dims import ISO2_TO_ISO3
from millrace.functions.rules import clamp, codes, level, text
from millrace.functions.text import lookup
from millrace.functions.validators import check_list

#: Two-letter countries that a nationality is known by.
KNOWN_COUNTRIES = (
    "VN US KR CN JP FR DE GB IT ES CA AU BR IN RU MX ID NL SA CH SE NO DK FI BE AT PT GR IE NZ SG MY TH PH HK TW AR CL CO ZA EG NG KE TR PL CZ HU RO UA IL AE PK BD KZ UZ QA KW OM IR MM LA KH MO MN NP LK"
).split()
#: Warnings that codes of validated fields stand for.
WARNING_OF_CODE = {"COUNTRY_CODE_REPAIRED": "COUNTRY_CODE_REPAIRED", "AMBIGUOUS_CHARS": "PASSPORT_NUMBER_REPAIRED", "TRAILING_OCR_NOISE": "LOW_CONFIDENCE_FIELD"}


def loose_date(v: Column) -> Column:
    """A date from yyyy-MM-dd or month/day/year, else null."""
    slashed = text(v).rlike(r"\A\d{2}/\d{2}/\d{4}\z")
    return F.coalesce(parsed(v), F.when(slashed, F.try_to_timestamp(v, F.lit("MM/dd/yyyy"))).cast("date"))


def _count(v: Column, what: str) -> Column:
    return F.length(v) - F.length(F.regexp_replace(v, what, ""))


def _capped(*caps: tuple[Column, float, str | None]) -> Column:
    """level, score, issues: 1 or the least cap whose condition holds, and the codes of all that hold."""
    held = [(F.coalesce(test, F.lit(False)), cap, code) for test, cap, code in caps]
    score = F.least(F.lit(1.0), *[F.when(test, F.lit(cap)).otherwise(1.0) for test, cap, _ in held])
    # array_except drops the nulls within generated code, which higher-order functions leave.
    issues = F.array_except(F.array(*[F.when(test, F.lit(code)) for test, _, code in held if code]), F.array(F.lit(None).cast("string")))
    return F.struct(level(score).alias("level"), score.alias("score"), issues.alias("issues"))


def name_accuracy(v: Column) -> Column:
    """level, score, issues of a name. Lengths are in code points; null counts as empty, which is too short."""
    v = text(v)
    n, digits = F.length(v), _count(v, "[0-9]")
    mostly = digits * 2 > n
    single = (n >= 3) & ~v.rlike(r"[ .-]") & v.rlike("[A-ZÀ-Ỹ]") & ((n - _count(v, "[a-zà-ỹ]")) * 10 > n * 7)
    return _capped(
        (mostly, 0.4, "MOSTLY_DIGITS"),
        (~mostly & (digits * 4 > n), 0.7, "UNUSUAL_DIGITS"),
        (n < 2, 0.3, "TOO_SHORT"),
        (n == 2, 0.7, "VERY_SHORT"),
        (single, 0.8, "GIVEN_NAME_MISSING"),
        (desk.whole(v, "[0-9]+"), 0.1, "ONLY_DIGITS"),
        (_count(v, r"[^a-zA-Z0-9\s\-'.À-Ỹà-ỹ]") * 10 > n * 3, 0.5, "UNUSUAL_CHARACTERS"),
    )


def date_accuracy(v: Column, kind: str, as_of: str) -> Column:
    """level, score, issues of a date of kind birth or expiry; as_of is the start of its day, ages are differences of years.

    A text that is no date but has the shape of day/month/year is worth a little more than others.
    """
    v, now = text(v), F.lit(as_of).cast("date")
    d = loose_date(v)
    first, second, year = (F.try_element_at(F.split(v, "/"), F.lit(k)).try_cast("int") for k in (1, 2, 3))
    shaped = v.rlike(r"\A\d{2}/\d{2}/\d{4}\z") & first.between(1, 31) & second.between(1, 12) & year.between(1901, 2099)
    shaped = F.coalesce(shaped, F.lit(False))
    rules = [(d.isNull() & ~shaped, 0.2, "INVALID_DATE"), (d.isNull() & shaped, 0.5, "INVALID_DATE"), (d.isNull() & shaped, 0.5, "AMBIGUOUS_ORDER")]
    if kind == "expiry":
        rules += [(d < now, 0.3, "EXPIRED"), (F.datediff(d, now).between(0, 89), 0.7, "NEAR_EXPIRY")]
    else:
        age = F.year(now) - F.year(d)
        rules += [((age <= 0) | (age >= 120), 0.2, "AGE_OUT_OF_RANGE"), (age.between(1, 4), 0.7, "VERY_YOUNG"), (age.between(91, 119), 0.8, None)]
    return _capped(*rules)


def gender_accuracy(v: Column) -> Column:
    """1 for M and F, 0 for UNKNOWN, .5 for others."""
    v = text(v)
    return _capped((v == "UNKNOWN", 0.0, "UNUSUAL_GENDER"), (~v.isin("M", "F", "UNKNOWN"), 0.5, "UNUSUAL_GENDER"))


def nationality_accuracy(v: Column) -> Column:
    """Two or three letters, two of them those of a known country."""
    v = text(v)
    two = desk.whole(v, "[A-Za-z]{2}")
    return _capped((~two & ~desk.whole(v, "[A-Za-z]{3}"), 0.4, "UNEXPECTED_FORMAT"), (two & ~F.upper(v).isin(KNOWN_COUNTRIES), 0.7, "UNRECOGNISED_COUNTRY"))


def blended(accuracy: Column, own: Column, overall: Column) -> Column:
    """An accuracy moved by the field's own confidence, where there is one, else by the record's where that is below .9; neither: as it was."""
    score, issues = accuracy["score"], accuracy["issues"]
    weight = F.when(own >= 0.9, 0.3).when(own >= 0.7, 0.4).otherwise(0.5)
    moved = F.when(own.isNotNull(), clamp(score * (1 - weight) + own * weight)).when(overall < 0.9, clamp(score * 0.7 + overall * 0.3)).otherwise(score)
    more = codes((own < 0.9, "OCR_CONFIDENCE"), (own < 0.7, "LOW_OCR_CONFIDENCE"), (own.isNull() & (overall < 0.7), "LOW_OVERALL_CONFIDENCE"))
    return F.struct(level(moved).alias("level"), moved.alias("score"), F.concat(issues, more).alias("issues"))


def accuracies(record: dict[str, Column], as_of: str) -> dict[str, Column]:
    """level, score, issues of each field of a record, in a fixed order.

    record has columns by name: fullName, surname, givenName, passportNumber, idNumber, dateOfBirth,
    passportExpiryDate, idExpiryDate, gender, nationality, issuingCountry; those left out are left out here too.
    """
    nation = record.get("nationality", F.lit(None).cast("string"))
    rules = {
        **dict.fromkeys(("fullName", "surname", "givenName"), name_accuracy),
        "passportNumber": lambda v: desk.passport_accuracy(v, nation),
        "idNumber": desk.card_accuracy,
        "dateOfBirth": lambda v: date_accuracy(v, "birth", as_of),
        **dict.fromkeys(("passportExpiryDate", "idExpiryDate"), lambda v: date_accuracy(v, "expiry", as_of)),
        "gender": gender_accuracy,
        **dict.fromkeys(("nationality", "issuingCountry"), nationality_accuracy),
    }
    return {name: rule(record[name]) for name, rule in rules.items() if name in record}


def row_checks(row_id: Column, status: Column, document: Column, name: Column, passport: Column, card: Column, confirmed: Column) -> Column:
    """Whether a record is there, has not failed (or that is confirmed), and has its name and its document's number."""
    needed = (text(name) != "") & ~((text(document) == "PASSPORT") & (text(passport) == "")) & ~((text(document) == "ID_CARD") & (text(card) == ""))
    return check_list({"guest_row_exists": text(row_id) != "", "guest_not_failed": (text(status) != "FAILED") | F.coalesce(confirmed, F.lit(False)), "required_fields_exist": needed})


def confidence_checks(score: Column) -> Column:
    """Null counts as 0."""
    score = F.coalesce(score, F.lit(0.0))
    return check_list({"high_confidence": score >= 0.9, "medium_confidence": score >= 0.7})


def auto_save_checks(mode: Column, selector: Column, control: Column, required: Column, status: Column) -> Column:
    """Whether a record may be saved unseen; required: the values, as an array, of the mappings that are enabled and required."""
    complete = F.forall(F.coalesce(required, F.array().cast("array<string>")), lambda v: text(v) != "")
    return check_list({"auto_save_enabled": text(mode) == "auto", "auto_save_configured": (text(selector) != "") | (text(control) != ""), "required_values_exist": complete, "guest_not_failed": text(status) != "FAILED"})


def mapped_value_checks(values: Column, mappings: Column) -> Column:
    """name, passed for each enabled mapping (source, enabled), in their order: whether the map values has something for its source."""
    on = F.filter(F.coalesce(mappings, F.array().cast("array<struct<source:string,enabled:boolean>>")), lambda m: F.coalesce(m["enabled"], F.lit(False)))
    return F.transform(on, lambda m: F.struct(F.concat(F.lit("field_"), m["source"]).alias("name"), (text(F.try_element_at(values, m["source"])) != "").alias("passed")))


def field_checks(record: dict[str, Column], as_of: str) -> Column:
    """checks (name, passed), passed, failed over what a record's fields say, by themselves and together.

    Checks that do not apply, as their fields are empty, are left out; some are only listed when they fail.
    record as for field_accuracies, and likelyGender (M, F, or null), what the name suggests.
    """
    f = {k: text(record.get(k, F.lit(None).cast("string"))) for k in ("fullName", "passportNumber", "idNumber", "dateOfBirth", "passportExpiryDate", "idExpiryDate", "gender", "nationality", "issuingCountry", "likelyGender")}
    name, passport, card, gender, nation, issuer = (f[k] for k in ("fullName", "passportNumber", "idNumber", "gender", "nationality", "issuingCountry"))
    now, born, expires = F.lit(as_of).cast("date"), loose_date(f["dateOfBirth"]), loose_date(f["passportExpiryDate"])
    age = F.year(now) - F.year(born)
    stated = ~gender.isin("", "UNKNOWN")
    always, never = F.lit(True), F.lit(False)
    rows = [  # when it is listed, name, whether it is passed
        (F.length(name) == 1, "field_fullName_length", never),
        (desk.whole(name, "[0-9]+"), "field_fullName_digits", never),
        (_count(name, "[0-9]") * 2 > F.length(name), "field_fullName_digitRatio", never),
        (passport != "", "field_passportNumber_format", desk.whole(passport, "[A-Za-z0-9]{5,20}")),
        (desk.whole(passport, "0+"), "field_passportNumber_zeros", never),
        ((passport != "") & (nation != "") & ~desk.passport_fits(passport, nation), "field_passportNumber_countryPattern", never),
        (card != "", "field_idNumber_format", desk.whole(card, "[A-Za-z0-9]{5,30}")),
        (f["dateOfBirth"] != "", "field_dateOfBirth_parse", born.isNotNull()),
        (born.isNotNull(), "field_dateOfBirth_range", age.between(1, 119)),
        (born > now, "field_dateOfBirth_future", never),
        (expires < now, "field_passportExpiryDate_expired", never),
        (loose_date(f["idExpiryDate"]) < now, "field_idExpiryDate_expired", never),
        (stated, "field_gender_value", gender.isin("M", "F")),
        ((nation != "") & (issuer != "") & (lookup(ISO2_TO_ISO3, nation, nation) != lookup(ISO2_TO_ISO3, issuer, issuer)), "field_nationality_consistency", never),
        (stated & (name != "") & f["likelyGender"].isin("M", "F") & (f["likelyGender"] != gender), "field_gender_name_consistency", never),
        (expires <= born, "field_expiry_vs_dob", never),
    ]
    checks = F.array_compact(F.array(*[F.when(listed & always, F.struct(F.lit(n).alias("name"), F.coalesce(passed, never).alias("passed"))) for listed, n, passed in rows]))
    failed = F.transform(F.filter(checks, lambda c: ~c["passed"]), lambda c: c["name"])
    return F.struct(checks.alias("checks"), (F.size(failed) == 0).alias("passed"), failed.alias("failed"))


def validation_warnings(results: Column) -> Column:
    """Warnings, each once, in the order in which validated fields (codes, needs_review) first give them; one to be reviewed without such a code is LOW_CONFIDENCE_FIELD."""

    def of_result(r: Column) -> Column:
        known = F.filter(F.coalesce(r["codes"], F.array().cast("array<string>")), lambda c: c.isin(*WARNING_OF_CODE))
        review = F.coalesce(r["needs_review"], F.lit(False)) & (F.size(known) == 0)
        return F.when(review, F.array(F.lit("LOW_CONFIDENCE_FIELD"))).otherwise(F.transform(known, lambda c: lookup(WARNING_OF_CODE, c, c)))

    return F.array_distinct(F.flatten(F.transform(F.coalesce(results, F.array().cast("array<struct<codes:array<string>,needs_review:boolean>>")), of_result)))
