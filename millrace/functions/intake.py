"""From recognised lines to a guest record: choice of parse and candidate, labelled fields, warnings, records, readiness and pre-fill checks, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import mrz, text
from millrace.functions.dates import normalize_date
from millrace.functions.rules import clamp, codes, plus

blank = text.text


def filled(v: Column) -> Column:
    return blank(v) != ""


#: What a parse is worth for each field that it has, and for digits that all hold.
COMPLETENESS = {"passport_number": 10, "surname": 5, "given_names": 5, "date_of_birth": 5, "expiry_date": 5, "nationality": 3}
KNOWN_SEX, ALL_DIGITS = 3, 20


def best_parse(l1: Column, l2: Column, l3: Column) -> Column:
    """score, rank, format, fields of the most complete of the three parses of lines padded to their lengths; TD3 before TD2 before TD1 among equals."""

    def tried(rank: int, fmt: str) -> Column:
        def scored(fields: Column, valid: Column) -> Column:
            have = [(filled(fields[name]), float(worth)) for name, worth in COMPLETENESS.items()]
            score = plus(0.0, *have, (fields["sex"] != "UNKNOWN", float(KNOWN_SEX)), (valid, float(ALL_DIGITS)))
            return F.struct(score.cast("int").alias("score"), F.lit(-rank).alias("rank"), F.lit(fmt).alias("format"), fields.alias("fields"))

        def judged(p: Column) -> Column:
            valid = F.size(mrz.validate(p["b"], F.lit(fmt))["errors"]) == 0
            return mrz.let(mrz.parse(p["a"], p["b"], p["c"], F.lit(fmt)), lambda fields: scored(fields, valid))

        return mrz.let(F.struct(*[mrz.pad_line(line, mrz.LAYOUTS[fmt].length).alias(n) for n, line in (("a", l1), ("b", l2), ("c", l3))]), judged)

    return F.array_max(F.array(*[tried(rank, fmt) for rank, fmt in enumerate(("TD3", "TD2", "TD1"))]))


#: A line's worth by its length, the first and second lines alike, and a third one's.
LENGTH_WORTH = {44: 40.0, 36: 35.0, 30: 30.0}
THIRD_WORTH = 25.0


def candidate_score(lines: Column, l1: Column, l2: Column, confidence: Column) -> Column:
    """What a recogniser's candidate is worth by its lines, their digits, stray characters and the recogniser's confidence."""

    def line(k: int) -> Column:
        return F.try_element_at(lines, F.lit(k))

    def by_length(v: Column) -> Column:
        n, out = F.length(blank(v)), F.lit(0.0)
        for length, worth in LENGTH_WORTH.items():
            out = F.when(n == length, worth).otherwise(out)
        return out

    checks = [(mrz.digit_ok(mrz.at(l2, start, n), mrz.at(l2, place, 1)), 100.0) for start, n, place in mrz.FIELDS.values()]
    td3 = mrz.LAYOUTS["TD3"]
    composite = mrz.digit_ok(F.concat(*[mrz.at(l2, s, n) for s, n in td3.parts]), mrz.at(l2, td3.composite_at, 1))
    n2 = F.length(blank(l2))
    digits = F.when(n2.isin(*LENGTH_WORTH), plus(0.0, *checks, ((n2 == td3.length) & composite, 200.0), (mrz.at(l2, 13, 7).rlike("[0-9]{6}"), 20.0))).otherwise(0.0)
    stray = F.length(F.regexp_replace(F.array_join(lines, ""), "[A-Z0-9<]", ""))
    fillers = F.length(blank(l1)) - F.length(F.replace(blank(l1), F.lit("<"), F.lit("")))
    moves = [
        (blank(l1).startswith("P<"), 20.0),
        (F.size(lines) >= 2, 80.0),
        (F.length(blank(line(3))) == 30, THIRD_WORTH),
        (fillers >= 5, 10.0),
        (stray > 10, -50.0),
        (~filled(l2), -100.0),
    ]
    return plus(by_length(line(1)) + by_length(line(2)) + digits, *moves) + F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)) * 50.0


#: The labels of an identity card's fields; the last line that matches counts.
CARD_FIELDS = {
    "id_number": r"(?:ID|IDENTITY|CITIZEN|NATIONAL)\s*(?:CARD|NO|NUMBER|ID)[\s:#.]*([A-Z0-9]+)",
    "full_name": r"(?:FULL\s*)?NAME[\s:#.]*(.+)",
    "date_of_birth": r"DOB[\s:#.]*([\d/.-]+)",
    "gender": r"SEX[\s:#.]*([MF])",
    "nationality": r"NATIONALITY[\s:#.]*([A-Z]+)",
    "issue_date": r"(?:ISSUE|ISSUED|DATE\s*OF\s*ISSUE)[\s:#.]*([\d/.-]+)",
    "expiry_date": r"(?:EXPIRY|EXPIRES|DATE\s*OF\s*EXPIRY)[\s:#.]*([\d/.-]+)",
}


def card_fields(raw: Column) -> Column:
    """The labelled fields of an identity card's text, empty where no line has one; an unknown gender is UNKNOWN. Labels are looked for anywhere in a line, so a word like VIETNAMESE counts as a name's label."""
    lines = F.transform(F.split(blank(raw), "\r\n|\r|\n"), lambda s: F.upper(F.trim(s)))

    def last(name: str, pattern: str) -> Column:
        found = F.filter(F.transform(lines, lambda s: F.trim(F.regexp_extract(s, pattern, 1))), lambda s: s != "")
        return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("UNKNOWN" if name == "gender" else ""))

    return F.struct(*[last(name, pattern).alias(name) for name, pattern in CARD_FIELDS.items()])


#: The columns of a guest record in order, and what stands in one that no source fills.
RECORD = {
    **dict.fromkeys(("full_name", "surname", "given_name", "passport_number", "id_number", "nationality", "date_of_birth"), ""),
    "gender": "UNKNOWN",
    **dict.fromkeys(("passport_expiry_date", "id_expiry_date", "issuing_country", "issuing_authority"), ""),
    "document_type": "UNKNOWN",
    **dict.fromkeys(("room_number", "arrival_date", "departure_date", "reservation_code"), ""),
    "status": "NEED_REVIEW",
    "confidence_score": 0.0,
    "confidence_level": "LOW",
    "note": "",
    "ocr_warning": "",
}
NORMALISERS = {
    **dict.fromkeys(("full_name", "surname", "given_name"), text.normalize_name),
    "passport_number": text.normalize_document_number,
    "id_number": lambda v: F.upper(F.trim(blank(v))),
    **dict.fromkeys(("nationality", "issuing_country"), lambda v: text.normalize_country(blank(v))),
    **dict.fromkeys(("date_of_birth", "passport_expiry_date", "id_expiry_date"), normalize_date),
    "gender": text.normalize_gender,
}
_PERSON = ("full_name", "nationality", "date_of_birth", "gender")
_PASSPORT = (*_PERSON, "surname", "given_name", "passport_number", "passport_expiry_date")
#: Which fields each source fills, in the order in which sources are taken: one source fills a whole record.
SOURCES = {"mrz": ("PASSPORT", (*_PASSPORT, "issuing_country")), "visual": ("PASSPORT", _PASSPORT), "card": ("ID_CARD", (*_PERSON, "id_number", "id_expiry_date"))}


def guest_record(row_id: Column, source_file: Column, found: dict[str, Column]) -> Column:
    """The 24 columns of a guest record. found maps mrz, visual and card to maps of raw field values; the first that is not null or empty fills the record, normalised, the others add nothing."""

    def has(source: str) -> Column:
        return F.coalesce(F.size(F.filter(F.map_keys(found[source]), lambda k: k.isNotNull())) > 0, F.lit(False))

    def value(name: str, empty) -> Column:
        out = F.lit(empty)
        for source in reversed([s for s in SOURCES if s in found]):
            kind, fields = SOURCES[source]
            if name == "document_type":
                own = F.lit(kind)
            else:
                own = NORMALISERS[name](F.try_element_at(found[source], F.lit(name))) if name in fields else F.lit(empty)
            out = F.when(has(source), own).otherwise(out)
        return out

    return F.struct(row_id.alias("row_id"), *[value(name, empty).alias(name) for name, empty in RECORD.items()], source_file.alias("source_file"))


def diagnostic(record: Column, quality: Column, engine: Column, has_mrz: Column, score: Column, errors: Column, took_ms: Column) -> Column:
    """The 14 columns of the diagnostic row that goes with a record. quality: struct of width, height, blur_score, brightness, contrast."""
    return F.struct(
        record["row_id"].alias("row_id"),
        record["source_file"].alias("source_file"),
        record["document_type"].alias("document_type_detected"),
        took_ms.alias("processing_time_ms"),
        *[quality[name].alias(out) for name, out in (("width", "image_width"), ("height", "image_height"), ("blur_score", "blur_score"), ("brightness", "brightness"), ("contrast", "contrast"))],
        engine.alias("selected_ocr_engine"),
        F.concat(F.lit("mrz_"), engine, F.when(has_mrz, "_found").otherwise("_not_found")).alias("selected_candidate"),
        score.alias("candidate_score"),
        F.array_join(errors, ";").alias("validation_summary"),
        record["ocr_warning"].alias("warnings"),
    )


#: The warnings that failed digits give; other failures give none.
DIGIT_WARNINGS = {
    "PASSPORT_NUMBER_CHECK_FAILED": "PASSPORT_NUMBER_CHECK_FAILED",
    "DATE_OF_BIRTH_CHECK_FAILED": "DOB_CHECK_FAILED",
    "EXPIRY_DATE_CHECK_FAILED": "EXPIRY_CHECK_FAILED",
    "COMPOSITE_CHECK_FAILED": "FINAL_CHECK_FAILED",
}


def collect_warnings(engine: Column, n_lines: Column, errors: Column, fields: Column, repairs: Column, visual_used: Column, quality: Column) -> Column:
    """All warnings in the order of the steps that give them, repeated ones repeated: recogniser, zone, digits, fields, repairs, visual reading, image."""
    none = F.array().cast("array<string>")
    pairs = F.create_map(*[F.lit(x) for p in DIGIT_WARNINGS.items() for x in p])
    digits = F.array_compact(F.transform(F.coalesce(errors, none), lambda e: F.try_element_at(pairs, e)))
    return F.concat(
        F.coalesce(engine, none),
        codes((F.coalesce(n_lines, F.lit(0)) < 2, "MRZ_NOT_FOUND")),
        digits,
        *[F.coalesce(a, none) for a in (fields, repairs)],
        codes((F.coalesce(visual_used, F.lit(False)), "VISUAL_OCR_USED")),
        F.coalesce(quality, none),
    )


#: The fields without which nothing is filled.
REQUIRED = ("fullName", "passportNumber", "dateOfBirth", "expiryDate", "nationality", "gender")


def fields_for_review(results: Column) -> Column:
    """Of an array of structs (field, valid, needs_review), the fields to look at."""
    return F.transform(F.filter(results, lambda r: r["needs_review"]), lambda r: r["field"])


def needs_review(results: Column) -> Column:
    return F.exists(results, lambda r: F.coalesce(r["needs_review"], F.lit(False)))


def is_ready(results: Column, required: tuple[str, ...] = REQUIRED) -> Column:
    """As many results as there are required fields, all of these valid and none to look at."""
    own = F.filter(results, lambda r: r["field"].isin(*required))
    return (F.size(own) >= len(required)) & F.forall(own, lambda r: r["valid"] & ~r["needs_review"])


def visual_confidence(resolved: Column, checks: Column) -> Column:
    """Of an array of structs (source, confidence) and a map of digits: fields read from the zone count whole, repaired ones .8, visual ones half of their confidence, a digit that holds .05."""

    def total(source: str, worth: Column | None = None) -> Column:
        own = F.filter(resolved, lambda r: r["source"] == source)
        return F.aggregate(own, F.lit(0.0), lambda a, r: a + (F.coalesce(r["confidence"], F.lit(0.0)) if worth is None else worth))

    bonus = F.size(F.filter(F.map_values(checks), lambda ok: ok)) * F.lit(0.05)
    got = total("mrz", F.lit(1.0)) + total("mrz_repaired", F.lit(0.8)) + total("visual_ocr") * 0.5 + bonus
    return F.when(F.size(resolved) <= 0, 0.0).otherwise(clamp(got / (F.size(resolved) + bonus)))


def prefill_errors(values: Column, mappings: Column, rules: Column) -> Column:
    """What forbids filling, as an array of structs (field, code).

    values: a map by form field; mappings: an array of structs (form_field, required, enabled); rules: one of
    (type, field). Required fields without a value come first, then dates that are not yyyy-MM-dd and unknown
    genders, then the fields that a field_exists rule names and that have none. Other rules forbid nothing here.
    """

    def of(name: Column) -> Column:
        return blank(F.try_element_at(values, name))

    def error(name: Column, code: str) -> Column:
        return F.struct(name.alias("field"), F.lit(code).alias("code"))

    enabled = F.filter(mappings, lambda m: m["enabled"])

    def misshaped(m: Column) -> Column:
        name, v = m["form_field"], of(m["form_field"])
        date = name.rlike("(?i)date.?of.?birth|expiry.?date|issue.?date|dob|birth.?date") & ~F.trim(v).rlike(r"^\d{4}-\d{2}-\d{2}$")
        gender = name.rlike("(?i)gender|sex") & ~F.upper(v).isin("M", "F", "X", "UNKNOWN")
        return (v != "") & (date | gender)

    return F.concat(
        F.transform(F.filter(enabled, lambda m: m["required"] & (F.trim(of(m["form_field"])) == "")), lambda m: error(m["form_field"], "EMPTY_VALUE")),
        F.transform(F.filter(enabled, misshaped), lambda m: error(m["form_field"], "INVALID_FORMAT")),
        F.transform(F.filter(rules, lambda r: (r["type"] == "field_exists") & filled(r["field"]) & (of(r["field"]) == "")), lambda r: error(r["field"], "SAFETY_RULE_BLOCKED")),
    )
