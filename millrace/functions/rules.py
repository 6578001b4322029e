"""Validation rules, scores and review states, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.dates import days_until, parsed


def text(v: Column) -> Column:
    return F.coalesce(v, F.lit(""))


def codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for c, code in pairs]))


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def plus(base: Column | float, *pairs: tuple[Column, float]) -> Column:
    start = base if isinstance(base, Column) else F.lit(base)
    return reduce(lambda a, p: a + F.when(p[0], F.lit(p[1])).otherwise(F.lit(0.0)), pairs, start)


def level(score: Column, high: float = 0.9, medium: float = 0.7, names: tuple[str, str, str] = ("HIGH", "MEDIUM", "LOW")) -> Column:
    return F.when(score >= high, names[0]).when(score >= medium, names[1]).otherwise(names[2])


def passport_warnings(name: Column, number: Column, birth: Column, expiry: Column, as_of: str) -> Column:
    left = days_until(expiry, as_of)
    return codes(
        (text(name) == "", "MISSING_FULL_NAME"),
        (text(number) == "", "MISSING_PASSPORT_NUMBER"),
        (text(birth) == "", "MISSING_DATE_OF_BIRTH"),
        (left < 0, "PASSPORT_EXPIRED"),
        ((left >= 0) & (left <= 90), "PASSPORT_EXPIRING_SOON"),
    )


def passport_confidence(has_mrz: Column, lines_valid: Column, checks: Column, complete: Column, n_warnings: Column, image_ok: Column, primary: Column, visual: Column, repaired: Column) -> Column:
    """Additive from .5, within 0 and 1."""
    digits = [(checks[k], 0.10) for k in ("passport_number", "date_of_birth", "expiry_date", "composite")]
    score = plus(0.5, (has_mrz, 0.15), (lines_valid, 0.10), *digits, (complete, 0.05), (image_ok, 0.05), (primary, 0.05), (visual, -0.15), (repaired, -0.20), (~image_ok, -0.20))
    return clamp(score - n_warnings * 0.10)


def id_card_confidence(qr: Column, fields: Column, layout: Column, date: Column, number: Column, image_ok: Column, n_warnings: Column, qr_conflict: Column) -> Column:
    score = plus(0.4, (qr, 0.25), (fields, 0.15), (layout, 0.10), (date, 0.10), (number, 0.10), (image_ok, 0.05), (qr_conflict, -0.20), (~image_ok, -0.20))
    return clamp(score - n_warnings * 0.10)


def row_status(score: Column, n_warnings: Column) -> Column:
    return F.when((score >= 0.9) & (n_warnings == 0), "READY").when(score >= 0.7, "NEED_REVIEW").otherwise("MISSING_DATA")


def field_score(ocr: Column, digit: Column, value: Column, kind: str, penalty: Column | float = 0.0) -> Column:
    """.2 + .8 of the recogniser's confidence, moved by the check digit and by what the value lacks."""
    lost = penalty if isinstance(penalty, Column) else F.lit(penalty)
    moves = [(digit, 0.1), (~digit, -0.2), (text(value) == "", -0.2), (ocr < 0.5, -0.15)]
    if kind == "date":
        moves.append(((text(value) != "") & parsed(value).isNull(), -0.15))
    if kind == "country":
        moves.append((~text(value).rlike("^[A-Z]{3}$"), -0.25))
    if kind in ("gender", "document"):
        moves.append((text(value) != "", 0.05))
    return clamp(plus(ocr * 0.8 + 0.2, *moves)) - lost


def quality_warnings(blur: Column, brightness: Column, contrast: Column, glare: Column, skew: Column, width: Column, height: Column, edge: Column, smallest: tuple[int, int] = (600, 450)) -> Column:
    return codes(
        (blur < 50, "BLURRY"),
        (brightness < 50, "TOO_DARK"),
        (brightness > 220, "OVEREXPOSED"),
        (contrast < 30, "LOW_CONTRAST"),
        (glare > 0.15, "GLARE"),
        (F.abs(skew) > 5, "SKEWED"),
        ((width < smallest[0]) | (height < smallest[1]), "LOW_RESOLUTION"),
        (edge < 0.3, "EDGES_NOT_VISIBLE"),
    )


#: What a warning costs a score.
QUALITY_PENALTIES = {"BLURRY": 0.15, "GLARE": 0.1, "TOO_DARK": 0.1, "LOW_CONTRAST": 0.08, "OVEREXPOSED": 0.1, "SKEWED": 0.05, "LOW_RESOLUTION": 0.1, "EDGES_NOT_VISIBLE": 0.05}


def quality_penalty(warnings: Column) -> Column:
    """The sum of the warnings' costs, .3 at most."""
    table = F.create_map(*[F.lit(x) for p in QUALITY_PENALTIES.items() for x in p])
    costs = F.transform(warnings, lambda w: F.coalesce(F.try_element_at(table, w), F.lit(0.0)))
    return F.least(F.aggregate(costs, F.lit(0.0), lambda a, x: a + x), F.lit(0.3))


def field_issues(value: Column, rules: dict) -> Column:
    """What a value breaks: required first and alone; then min_length, max_length, pattern. A blank optional value breaks nothing."""
    v = text(value)
    blank = F.trim(v) == ""
    found = codes(
        *([(F.length(v) < rules["min_length"], "TOO_SHORT")] if "min_length" in rules else []),
        *([(F.length(v) > rules["max_length"], "TOO_LONG")] if "max_length" in rules else []),
        *([(~v.rlike(rules["pattern"]), "PATTERN")] if "pattern" in rules else []),
    )
    return F.when(blank, F.array(F.lit("REQUIRED")) if rules.get("required") else F.array().cast("array<string>")).otherwise(found)


def form_issues(columns: dict[str, Column], rules: dict[str, dict], cross: tuple[tuple[str, Column, str], ...] = ()) -> Column:
    """Map of each field with issues to their codes; cross rules (field, broken, code) come behind the field's own."""
    entries = []
    for field, value in columns.items():
        more = codes(*[(broken, code) for f, broken, code in cross if f == field])
        entries.append(F.struct(F.lit(field).alias("key"), F.concat(field_issues(value, rules.get(field, {})), more).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def cross_field_issues(country: Column, nationality: Column, birth: Column, expiry: Column, name: Column, surname: Column) -> Column:
    years = F.datediff(parsed(expiry), parsed(birth)) / 365.25
    return codes(
        ((text(country) != "") & (text(nationality) != "") & (country != nationality), "COUNTRY_MISMATCH"),
        ((text(surname) != "") & ~F.upper(text(name)).contains(F.upper(text(surname))), "NAME_MISMATCH"),
        (parsed(expiry) <= parsed(birth), "EXPIRY_BEFORE_BIRTH"),
        ((years > 0) & ((years < 15) | (years > 100)), "IMPLAUSIBLE_VALIDITY"),
    )


def review_status(resolved: Column, needs_review: Column, errors: Column, empty_critical: Column) -> Column:
    """status and its reasons in order: FAILED with three empty critical fields or more, NEED_REVIEW for any other reason, else AUTO_FILLED."""
    reasons = codes((empty_critical > 0, "MISSING_CRITICAL_FIELD"), (errors, "VALIDATION_ERROR"), (needs_review, "FIELD_NEEDS_REVIEW"), (~resolved, "UNRESOLVED_FIELD"))
    return F.struct(F.when(empty_critical >= 3, "FAILED").when(F.size(reasons) > 0, "NEED_REVIEW").otherwise("AUTO_FILLED").alias("status"), reasons.alias("reasons"))


def all_present_true(m: Column, keys: tuple[str, ...]) -> Column:
    """Whether every one of the keys that the map has is true; false if it has none."""
    own = F.map_values(F.map_filter(m, lambda k, v: k.isin(*keys)))
    return (F.size(own) > 0) & F.forall(own, lambda x: x)


def resolve_field(mrz: Column, digit: Column, visual: Column, visual_confidence: Column) -> Column:
    """value, source, confidence, needs_review: the zone's value unless its digit failed and the visual one is there."""
    zone, seen = text(mrz) != "", text(visual) != ""
    take_visual = seen & (~zone | ~digit)
    source = F.when(take_visual, "visual").when(zone, "mrz").otherwise("unresolved")
    confidence = F.when(take_visual & zone, F.greatest(F.lit(0.65), visual_confidence)).when(take_visual, F.greatest(F.lit(0.5), visual_confidence)).when(zone & digit, 0.98).when(zone, 0.85).otherwise(0.0)
    return F.struct(F.when(take_visual, visual).otherwise(text(mrz)).alias("value"), source.alias("source"), confidence.alias("confidence"), (confidence < 0.7).alias("needs_review"))


def conflict(mrz: Column, digit: Column, visual: Column, confidence: Column) -> Column:
    """value, source, confidence, conflict of a visual value against the zone's."""
    zone, seen = text(mrz) != "", text(visual) != ""
    same = F.upper(F.trim(text(mrz))) == F.upper(F.trim(text(visual)))
    wins = digit | (confidence < 0.6)
    pick = [
        (~zone, visual, F.lit("visual"), confidence, F.lit(False)),
        (~seen, mrz, F.lit("mrz"), F.lit(0.95), F.lit(False)),
        (same, mrz, F.lit("mrz"), F.when(digit, 0.98).otherwise(0.88), F.lit(False)),
        (wins, mrz, F.when(digit, "mrz").otherwise("mrz_repaired"), F.when(digit, 0.95).otherwise(0.85), F.lit(True)),
    ]
    value, source, score, clash = text(visual), F.lit("visual"), confidence, confidence < 0.7
    for test, *chosen in reversed(pick):
        value, source, score, clash = (F.when(test, c).otherwise(o) for c, o in zip(chosen, (value, source, score, clash), strict=True))
    return F.struct(text(value).alias("value"), source.alias("source"), score.alias("confidence"), clash.alias("conflict"))
