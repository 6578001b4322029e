"""Masking of personal values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as sensitive in free text, in the order of replacement.
SENSITIVE = (r"\b[A-Z]\d{8}\b", r"\b\d{9,12}\b", r"\b\d{2}[/-]\d{2}[/-]\d{4}\b", r"\b\d{4}\s*\d{4}\s*\d{4}\s*\d{4}\b")
REDACTED = "***REDACTED***"


def mask_start(v: Column, keep: int = 4, mark: str = "*") -> Column:
    """The first characters stay; values no longer than that stay whole."""
    return F.concat(F.substring(v, 1, keep), F.repeat(F.lit(mark), F.greatest(F.length(v) - keep, F.lit(0))))


def mask_full_name(v: Column, dialect: str = "worker") -> Column:
    """The last word after its first character. The worker splits at white space, the service at single spaces."""
    words = F.split(F.trim(v), r"\s+") if dialect == "worker" else F.split(v, " ")
    last = F.element_at(words, -1)
    hidden = F.concat(F.substring(last, 1, 1), F.repeat(F.lit("*"), F.greatest(F.length(last) - 1, F.lit(0))))
    return F.concat_ws(" ", F.slice(words, F.lit(1), F.size(words) - 1), F.array(hidden))


def mask_mrz(v: Column) -> Column:
    """Five characters stay, and the last of more than ten; texts no longer than that stay whole."""
    return F.when(F.length(v) <= 5, v).when(F.length(v) <= 10, F.concat(F.substring(v, 1, 5), F.lit("*****"))).otherwise(F.concat(F.substring(v, 1, 5), F.lit("****"), F.right(v, F.lit(1))))


def mask_middle(v: Column) -> Column:
    """Two characters, three stars, one character; up to four characters are four stars."""
    return F.when(F.length(v) <= 4, "****").otherwise(F.concat(F.substring(v, 1, 2), F.lit("***"), F.right(v, F.lit(1))))


def has_sensitive(v: Column) -> Column:
    return F.coalesce(v, F.lit("")).rlike("|".join(SENSITIVE))


def strip_sensitive(v: Column) -> Column:
    for pattern in SENSITIVE:
        v = F.regexp_replace(v, pattern, F.lit(REDACTED))
    return v


def sensitive_key(key: Column) -> Column:
    return F.lower(key).rlike("id|passport|name|birth|phone|email|number")


def mask_map(m: Column, longest: int = 2000) -> Column:
    """Values under sensitive keys are masked, all are cut to longest characters."""
    return F.transform_values(m, lambda k, v: F.when(sensitive_key(k), mask_middle(v)).otherwise(F.substring(v, 1, longest)))
