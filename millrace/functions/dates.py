"""Date normalisers and date rules, as Column expressions. Nothing reads the clock: as_of is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(v: Column) -> Column:
    return F.coalesce(v, F.lit(""))


def _iso(v: Column, pattern: str, year: int, month: int, day: int, pivot: int | None = None) -> Column:
    """ISO date from a pattern's groups if it is a real one, else null."""
    y = F.regexp_extract(v, pattern, year)
    if pivot is not None:
        y = F.when(y.try_cast("int") <= pivot, F.concat(F.lit("20"), y)).otherwise(F.concat(F.lit("19"), y))
    parts = F.concat_ws("-", y, F.lpad(F.regexp_extract(v, pattern, month), 2, "0"), F.lpad(F.regexp_extract(v, pattern, day), 2, "0"))
    return F.when(v.rlike(pattern) & F.try_to_date(parts, "yyyy-MM-dd").isNotNull(), parts)


def normalize_date(raw: Column, dialect: str = "worker") -> Column:
    """To yyyy-MM-dd.

    worker: eight digits as day, month, year before year, month, day; six digits with pivot 69; with - / or .
    year first, else day first, else month first, else a two-digit year; what fails stays as it was.
    service: ISO as it is, six digits with pivot 49, eight digits year first, any separator; what fails stays.
    util: ISO or day first anywhere in the text, eight digits of 1900 to 2100, six digits with pivot 70, without
    a calendar check; what fails is null.
    """
    v = F.replace(F.trim(text(raw)), F.lit(" "), F.lit(""))
    if dialect == "util":
        iso, dmy, eight, six = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{2})[-/.](\d{2})[-/.](\d{4})", r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{2})(\d{2})(\d{2})$"

        def parts(p: str, *order: int) -> Column:
            return F.concat_ws("-", *[F.regexp_extract(v, p, k) for k in order])

        year = F.regexp_extract(v, eight, 1).try_cast("int")
        yy = F.regexp_extract(v, six, 1).try_cast("int")
        century = F.when(yy <= 70, "20").otherwise("19")
        return F.when(v.rlike(iso), parts(iso, 1, 2, 3)).when(v.rlike(dmy), parts(dmy, 3, 2, 1)).when(v.rlike(eight) & year.between(1900, 2100), parts(eight, 1, 2, 3)).when(v.rlike(six), F.concat(century, parts(six, 1, 2, 3)))
    eight, six = r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{2})(\d{2})(\d{2})$"
    if dialect == "service":
        return F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v).otherwise(
            F.coalesce(_iso(v, six, 1, 2, 3, 49), _iso(v, eight, 1, 2, 3), _iso(v, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", 1, 2, 3), _iso(v, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", 3, 2, 1), raw)
        )
    tried = [_iso(v, r"^(\d{2})(\d{2})(\d{4})$", 3, 2, 1), _iso(v, eight, 1, 2, 3), _iso(v, six, 1, 2, 3, 68)]
    for mark in ("-", "/", r"\."):
        tried += [
            _iso(v, rf"^(\d{{4}}){mark}(\d{{1,2}}){mark}(\d{{1,2}})$", 1, 2, 3),
            _iso(v, rf"^(\d{{1,2}}){mark}(\d{{1,2}}){mark}(\d{{4}})$", 3, 2, 1),
            _iso(v, rf"^(\d{{1,2}}){mark}(\d{{1,2}}){mark}(\d{{4}})$", 3, 1, 2),
            _iso(v, rf"^(\d{{1,2}}){mark}(\d{{1,2}}){mark}(\d{{2}})$", 3, 2, 1, 68),
        ]
    return F.when(text(raw) == "", "").otherwise(F.coalesce(*tried, raw))


def parsed(v: Column) -> Column:
    """A date from a strict yyyy-MM-dd, else null."""
    return F.when(text(v).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(v, "yyyy-MM-dd"))


def days_until(v: Column, as_of: str) -> Column:
    return F.datediff(parsed(v), F.lit(as_of).cast("date"))


def expiry_state(v: Column, as_of: str, months: int = 3) -> Column:
    """EXPIRED before as_of, EXPIRING up to so many months behind it, VALID, or UNKNOWN without a date."""
    d, now = parsed(v), F.lit(as_of).cast("date")
    return F.when(d.isNull(), "UNKNOWN").when(d < now, "EXPIRED").when(d <= F.add_months(now, months), "EXPIRING").otherwise("VALID")


def age_years(v: Column, as_of: str) -> Column:
    return F.floor(F.months_between(F.lit(as_of).cast("date"), parsed(v)) / 12).cast("int")


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def date_rule(v: Column, as_of: str, past: bool = False, future: bool = False, least: str | None = None, most: str | None = None) -> Column:
    """The first rule that v breaks: INVALID, NOT_PAST, NOT_FUTURE, TOO_EARLY, TOO_LATE; null if none."""
    d, now = parsed(v), F.lit(as_of).cast("date")
    out = F.when(d.isNull(), "INVALID")
    if past:
        out = out.when(d >= now, "NOT_PAST")
    if future:
        out = out.when(d <= now, "NOT_FUTURE")
    if least:
        out = out.when(d < F.lit(least).cast("date"), "TOO_EARLY")
    if most:
        out = out.when(d > F.lit(most).cast("date"), "TOO_LATE")
    return out
