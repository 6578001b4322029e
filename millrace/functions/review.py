"""What reviewers are shown: recommendations, classes of errors, choice of bands, merged lists and sections, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.dates import parsed, text


def _advice(*rows: tuple[Column, str, str, str]) -> Column:
    """The (field, priority, code) whose conditions hold, in the given order."""
    row = "struct<field:string,priority:string,code:string>"
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(p).alias("priority"), F.lit(k).alias("code"))).otherwise(F.lit(None).cast(row)) for c, f, p, k in rows]))


def recommendations(name: Column, surname: Column, passport: Column, card: Column, birth: Column, expiry: Column, nationality: Column, as_of: str) -> Column:
    """What to look at in a guest record, as an array of structs (field, priority, code).

    Null and empty fields give no advice. Dates of birth are ISO or month/day/year; one whose first part can only
    be the day is named as such, any other is unreadable. Ages are differences of years. Country patterns and
    issues across fields are validate_field's and cross_field_issues'.
    """
    name, surname, passport, card, birth, nationality = (text(c) for c in (name, surname, passport, card, birth, nationality))
    digits = F.length(F.regexp_replace(name, "[^0-9]", ""))
    parts = birth.rlike(r"^\d{2}/\d{2}/\d{4}$")
    born = F.coalesce(parsed(birth), F.when(parts, F.try_to_timestamp(birth, F.lit("MM/dd/yyyy"))).cast("date"))
    first, second = (F.when(parts, F.substring(birth, at, 2).cast("int")) for at in (1, 4))
    day_first = born.isNull() & (first > 12) & (second <= 12)
    age = F.lit(int(as_of[:4])) - F.year(born)
    days = F.datediff(parsed(text(expiry)), F.lit(as_of).cast("date"))
    return _advice(
        (F.length(name).between(1, 2), "fullName", "high", "NAME_TOO_SHORT"),
        (digits * 2 > F.length(name), "fullName", "high", "NAME_MOSTLY_DIGITS"),
        ((surname != "") & (name == surname), "fullName", "medium", "GIVEN_NAME_MISSING"),
        (F.size(tx.ambiguity_warnings(passport)) > 0, "passportNumber", "high", "AMBIGUOUS_CHARACTERS"),
        (passport.rlike("^0+$"), "passportNumber", "high", "PLACEHOLDER_NUMBER"),
        (F.length(passport).between(1, 5), "passportNumber", "medium", "NUMBER_TOO_SHORT"),
        (F.size(tx.ambiguity_warnings(card)) > 0, "idNumber", "medium", "AMBIGUOUS_CHARACTERS"),
        (age > 100, "dateOfBirth", "high", "AGE_TOO_HIGH"),
        (age < 1, "dateOfBirth", "high", "INFANT"),
        (day_first, "dateOfBirth", "medium", "DAY_FIRST"),
        ((birth != "") & born.isNull() & ~F.coalesce(day_first, F.lit(False)), "dateOfBirth", "high", "UNREADABLE_DATE"),
        (days.between(0, 89), "passportExpiryDate", "high", "EXPIRES_SOON"),
        (days < 0, "passportExpiryDate", "high", "EXPIRED"),
        (F.length(nationality) == 2, "nationality", "low", "TWO_LETTER_COUNTRY"),
    )


#: Errors that are not of plain severity, and those that may be tried again.
SEVERITIES = {"IPC_UNAVAILABLE": "critical", "VALIDATION_ERROR": "warning"}
RETRYABLE = ("TIMEOUT", "RATE_LIMITED", "NETWORK_ERROR")
#: Levels of log lines, least first.
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")


def error_class(code: Column) -> Column:
    """severity and retryable of an error code; an unknown or null one is a plain error."""
    return F.struct(tx.lookup(SEVERITIES, code, F.lit("error")).alias("severity"), F.coalesce(code.isin(*RETRYABLE), F.lit(False)).alias("retryable"))


def at_least(level: Column, threshold: str) -> Column:
    """Whether a log line's level reaches the threshold; unknown and null levels do not."""
    return F.coalesce(level.isin(*LEVELS[LEVELS.index(threshold) :]), F.lit(False))


def merged_lists(*lists: Column) -> Column:
    """All lists' distinct entries in order of their first occurrence; null lists count as empty."""
    return F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists]))


def error_summary(errors: Column) -> Column:
    """Of a map from fields to lists of errors: "N errors in M fields", empty for an empty or null map."""
    total = F.aggregate(F.map_values(errors), F.lit(0), lambda n, e: n + F.greatest(F.size(e), F.lit(0)))
    fields = F.size(errors)

    def counted(n: Column, noun: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))

    return F.when(fields > 0, F.concat(counted(total, "error"), F.lit(" in "), counted(fields, "field"))).otherwise("")


def check_share(checks: Column) -> Column:
    """Share of a map's check digits that hold, 0 for an empty or null map."""
    return F.when(F.size(checks) > 0, F.size(F.filter(F.map_values(checks), lambda ok: ok)) / F.size(checks)).otherwise(0.0)


def total_score(confidence: Column, checks: Column, weights: tuple[float, float] = (0.5, 0.5)) -> Column:
    """Confidence and share of check digits, weighted."""
    return confidence * weights[0] + check_share(checks) * weights[1]


#: Characters that a recogniser takes for others, in numbers and, further ones, in dates.
CONFUSED, CONFUSED_IN_DATES = "O0I1", "O0I1LZSBG"


def ambiguous_positions(v: Column, kind: str) -> Column:
    """Places, from 0, of characters that may be misread; kind date and expiry know more of them."""
    known = list(CONFUSED_IN_DATES if kind in ("date", "expiry") else CONFUSED)
    places = F.when(F.length(v) > 0, F.sequence(F.lit(0), F.length(v) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.substring(v, i + 1, F.lit(1)).isin(*known))


def zone_format(lines: Column, band_height: Column, image_height: Column) -> Column:
    """A zone's format by its lines and the height of its band: over a tenth of the image is TD2."""
    tall = F.coalesce(F.try_divide(band_height, image_height) > 0.1, F.lit(False))
    return F.when(lines >= 3, "TD1").when((lines == 2) & tall, "TD2").when(lines == 2, "TD3").otherwise("UNKNOWN")


def choose_band(bands: Column, image_height: Column, start: float, least: float, most: float, alike: float = 0.05) -> Column:
    """Of an array of structs (first, last, density), rows from first to last, the band that holds the zone, or null.

    Bands begin below start of the image's height and are least to most of it high. A band goes before those ahead of it in
    the array when it is denser by over alike, or about as dense and lower. That is no order, so the array's own
    order counts: it is folded from the left.
    """
    high = F.coalesce(image_height, F.lit(0))
    fit = F.filter(bands, lambda b: (b["first"] >= F.floor(high * start)) & (b["last"] - b["first"] + 1).between(high * least, high * most))

    def better(a: Column, b: Column) -> Column:
        gap = b["density"] - a["density"]
        return F.when((gap > alike) | ((F.abs(gap) <= alike) & (b["first"] > a["first"])), b).otherwise(a)

    return F.aggregate(F.slice(fit, F.lit(2), F.greatest(F.size(fit) - 1, F.lit(0))), F.get(fit, F.lit(0)), better)


def country_of_lines(lines: Column) -> Column:
    """The first code of three letters behind the two letters that begin a line, or null."""
    codes = F.transform(lines, lambda x: F.when(F.length(x) >= 5, F.replace(F.substring(x, 3, 3), F.lit("<"), F.lit(""))))
    return F.get(F.filter(codes, lambda c: c.rlike(r"^\p{L}{3}$")), F.lit(0))


def fields_in_order(values: Column, levels: Column, scores: Column, order: tuple[str, ...]) -> Column:
    """Of three maps by field: structs (key, value, level, score) of the fields that values has, in the given order; a field without accuracy is HIGH, 1."""

    def own(f: str) -> Column:
        key = F.lit(f)
        return F.when(
            F.map_contains_key(values, key),
            F.struct(key.alias("key"), text(F.try_element_at(values, key)).alias("value"), F.coalesce(F.try_element_at(levels, key), F.lit("HIGH")).alias("level"), F.coalesce(F.try_element_at(scores, key), F.lit(1.0)).alias("score")),
        )

    return F.array_compact(F.array(*map(own, order)))


def copyable(ordered: Column, level: str = "HIGH") -> Column:
    """Keys of the non-empty fields of a level, of what fields_in_order gives."""
    return F.transform(F.filter(ordered, lambda f: (f["level"] == level) & (f["value"] != "")), lambda f: f["key"])


def merged_sections(stored: Column, defaults: dict[str, dict[str, str]]) -> Column:
    """stored, a map of maps of settings, over the defaults, section by section; sections that have no defaults go, further keys stay."""

    def section(name: str, own: dict[str, str]) -> Column:
        got = F.coalesce(F.try_element_at(stored, F.lit(name)), F.create_map().cast("map<string,string>"))
        known = F.create_map(*[x for k, d in own.items() for x in (F.lit(k), F.coalesce(F.try_element_at(got, F.lit(k)), F.lit(d)))])
        return F.map_concat(known, F.map_filter(got, lambda k, _: ~k.isin(*own)))

    return F.create_map(*[x for n, own in defaults.items() for x in (F.lit(n), section(n, own))])


def changed_sections(before: Column, after: Column, sections: tuple[str, ...]) -> Column:
    """The sections whose settings differ, in the given order; the order of keys does not count."""

    def entries(m: Column, name: str) -> Column:
        return F.array_sort(F.map_entries(F.try_element_at(m, F.lit(name))))

    differs = [F.when(~entries(before, s).eqNullSafe(entries(after, s)), F.lit(s)) for s in sections]
    return reduce(lambda a, b: F.concat(a, b), [F.array_compact(F.array(d)) for d in differs])
