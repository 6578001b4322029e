"""Guest records: import, search, summaries, joins with events, conflict resolution, mapping to targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.functions import text as tx

#: Canonical columns and the names, without space, underscore and hyphen, that headers have for them.
HEADER_NAMES = {
    "fullName": "fullname name guestname",
    "surname": "surname lastname familyname",
    "givenName": "givenname firstname givennames",
    "gender": "gender sex",
    "dateOfBirth": "dateofbirth dob birthdate",
    "nationality": "nationality country",
    "documentType": "documenttype doctype",
    "passportNumber": "passportnumber passportno passport",
    "idNumber": "idnumber idno",
    "passportExpiryDate": "passportexpirydate expirydate expiry",
    "phone": "phone phonenumber mobile",
    "roomNumber": "roomnumber room",
}
_CANONICAL = {name: canonical for canonical, names in HEADER_NAMES.items() for name in names.split()}


def header_map(columns: list[str]) -> dict[str, str]:
    """Column to canonical name; unknown ones keep theirs, and of several for one name the first counts."""
    out: dict[str, str] = {}
    for c in columns:
        canonical = _CANONICAL.get(c.lower().replace(" ", "").replace("_", "").replace("-", ""), c)
        if canonical not in out.values():
            out[c] = canonical
    return out


def import_rows(raw: DataFrame, required: tuple[str, ...] = ("fullName",)) -> DataFrame:
    """Canonical columns as trimmed strings, null as empty, rows without a name left out; confidences (*_conf) within 0 and 1 as a map."""
    names = header_map(raw.columns)
    missing = [r for r in required if r not in names.values()]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    plain = {c: n for c, n in names.items() if not c.lower().endswith("_conf")}
    scored = [c for c in raw.columns if c.lower().endswith("_conf")]
    columns = [F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(n) for c, n in plain.items()]
    if scored:
        entries = F.array(*[F.struct(F.lit(c[:-5]).alias("key"), F.col(f"`{c}`").try_cast("double").alias("value")) for c in scored])
        columns.append(F.map_from_entries(F.filter(entries, lambda e: e["value"].between(0, 1))).alias("fieldConfidence"))
    return raw.select(*columns).where(F.col(required[0]) != "")


def search(rows: DataFrame, text: str = "", columns: tuple[str, ...] = (), equal: dict[str, str] | None = None) -> DataFrame:
    """Rows where any column holds the text, letter case aside, and where each of equal's columns has its value; ALL does not restrict."""
    if text:
        rows = rows.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower()) for c in columns]))
    for column, value in (equal or {}).items():
        if value != "ALL":
            rows = rows.where(F.col(column) == value)
    return rows


def job_summary(rows: DataFrame, by: list[str], file: str, status: str, confidence: str) -> DataFrame:
    """Distinct files, rows, rows by status, mean confidence to two places."""
    states = {"ready": "READY", "review": "NEED_REVIEW", "missing": "MISSING_DATA", "failed": "FAILED"}
    counts = [F.count_if(F.col(status) == s).alias(n) for n, s in states.items()]
    return rows.groupBy(*by).agg(F.count_distinct(file).alias("files"), F.count("*").alias("n_rows"), *counts, F.round(F.coalesce(F.avg(confidence), F.lit(0.0)), 2).alias("mean_confidence"))


def weighted_confidence(scores: Column, weights: Column) -> Column:
    """Weighted mean of an aggregate's rows, 0 without weight."""
    total = F.sum(weights)
    return F.when(total > 0, F.sum(scores * weights) / total).otherwise(0.0)


def fill_log(events: DataFrame, guests: DataFrame, event_key: str, guest_key: str) -> DataFrame:
    """Events with their guests, kept without one; Spark picks broadcast or sort-merge by size."""
    return events.join(guests, events[event_key] == guests[guest_key], "left")


def resolve_conflicts(visual: DataFrame, zone: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of (keys, visual, confidence) and (keys, mrz, digit), then the rules of precedence."""
    joined = visual.join(zone, keys, "full")
    picked = rules.conflict(F.col("mrz"), F.coalesce(F.col("digit"), F.lit(False)), F.col("visual"), F.coalesce(F.col("confidence"), F.lit(0.0)))
    return joined.select(*keys, picked.alias("_p")).select(*keys, "_p.*")


def with_remainder(results: DataFrame, conflicts: DataFrame, keys: list[str]) -> DataFrame:
    """results(keys, value) with conflicts' values over their own, and the conflicts that results lack."""
    own = results.join(conflicts.withColumnRenamed("value", "_better"), keys, "left").select(*keys, F.coalesce("_better", "value").alias("value"))
    return own.unionByName(conflicts.join(results, keys, "left_anti").where(F.col("value") != "").select(*keys, "value"))


def unpivot_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, position, field, value in the given order of fields."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in fields])
    return rows.select(key, F.posexplode(entries).alias("position", "_f")).select(key, "position", "_f.*")


def apply_mappings(rows: DataFrame, mappings: list[dict], keep: list[str]) -> DataFrame:
    """keep, then each enabled mapping's target from its source through its rules; of several for a target the last counts."""
    targets = {m["target"]: tx.apply_rules(F.col(m["source"]).cast("string"), m.get("transforms", [])) for m in mappings if m.get("enabled", True)}
    return rows.select(*keep, *[c.alias(t) for t, c in targets.items()])


def mapping_report(rows: DataFrame, mappings: list[dict], fields: list[str], required: list[str], key: str) -> DataFrame:
    """key, unmapped (non-empty fields without an enabled mapping), missing_targets (required ones without)."""
    enabled = [m for m in mappings if m.get("enabled", True)]
    used, targets = {m["source"] for m in enabled}, {m["target"] for m in enabled}
    unmapped = rules.codes(*[(F.coalesce(F.col(f).cast("string"), F.lit("")) != "", f) for f in fields if f not in used])
    missing = [r for r in required if r not in targets]
    return rows.select(key, unmapped.alias("unmapped"), F.array(*map(F.lit, missing)).cast("array<string>").alias("missing_targets"))


def duplicate_mappings(mappings: DataFrame) -> DataFrame:
    """Mappings whose (source, target) or, letter case aside, target another has."""
    from pyspark.sql import Window

    same = F.count("*").over(Window.partitionBy("source", "target")) > 1
    alike = F.count("*").over(Window.partitionBy(F.lower("target"))) > 1
    return mappings.select("*", same.alias("duplicate"), (alike & ~same).alias("similar"))


def outcome(filled: Column, failed: Column, skipped: Column) -> Column:
    return F.when((failed == 0) & (skipped == 0), "SUCCESS").when(filled > 0, "PARTIAL").otherwise("FAILED")


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns], F.lit(""))


def overlay(base: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Sparse edits over a base: an edit wins wherever it is not null, even when empty. n_edits counts those that change something."""
    e = edits.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = base.join(e, base[key] == F.col("_key"), "left")
    changed = reduce(lambda a, b: a + b, [(F.col(f"_{f}").isNotNull() & ~F.col(f"_{f}").eqNullSafe(F.col(f))).cast("int") for f in fields])
    return joined.select(key, *[F.coalesce(F.col(f"_{f}"), F.col(f)).alias(f) for f in fields], changed.alias("n_edits"))
