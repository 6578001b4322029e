"""Review records: what staff look at, their edits, and the confirmed result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import fields, safety
from millrace.functions.rules import text

#: The fields that staff may edit.
EDITABLE = (
    "fullName",
    "firstName",
    "lastName",
    "gender",
    "dateOfBirth",
    "nationality",
    "countryCode",
    "documentType",
    "documentNumber",
    "passportNumber",
    "idNumber",
    "issueDate",
    "expiryDate",
    "issuingCountry",
)


def pending(rows: DataFrame, key: str, fields: Column, levels: Column, confirmed: Column | None = None) -> DataFrame:
    """key, fields (a map), low (sorted fields of level LOW or MEDIUM), edits (the editable fields as they are), confirmed."""
    low = F.array_sort(F.map_keys(F.map_filter(levels, lambda _, v: v.isin("LOW", "MEDIUM"))))
    edits = F.map_filter(fields, lambda k, _: k.isin(*EDITABLE))
    return rows.select(key, fields.alias("fields"), F.coalesce(low, F.array().cast("array<string>")).alias("low"), edits.alias("edits"), (F.lit(False) if confirmed is None else F.coalesce(confirmed, F.lit(False))).alias("confirmed"))


def edited(reviews: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """reviews with changes(key, seq, field, value) applied: a field's last change counts.

    Changes of other fields, of records already confirmed, and of null values are refused. A record's changes
    are reduced to one a field before they meet, so a record with many of them is no hot group.
    """
    last = changes.where(F.col("field").isin(*EDITABLE) & F.col("value").isNotNull()).groupBy(key, "field").agg(F.max_by("value", "seq").alias("value"))
    wanted = last.groupBy(F.col(key).alias("_key")).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_wanted"))
    joined = reviews.join(wanted, reviews[key] == F.col("_key"), "left")
    merged = F.map_zip_with("edits", "_wanted", lambda _, old, new: F.coalesce(new, old))
    return joined.withColumn("edits", F.when(~F.col("confirmed") & F.col("_wanted").isNotNull(), merged).otherwise(F.col("edits"))).drop("_key", "_wanted")


def confirm(reviews: DataFrame, as_of: str) -> DataFrame:
    """reviews with result (the edits over the fields), has_edits, and when they were confirmed."""
    result = F.map_zip_with("fields", "edits", lambda _, old, new: F.coalesce(new, old))
    before = F.map_filter("fields", lambda k, _: k.isin(*EDITABLE))
    changed = F.array_sort(F.map_entries("edits")) != F.array_sort(F.map_entries(before))
    return reviews.select("*", result.alias("result"), changed.alias("has_edits"), F.lit(as_of).cast("timestamp").alias("confirmed_at")).withColumn("confirmed", F.lit(True))


def field_accuracies(records: DataFrame, keep: list[str], record: dict[str, Column], confidences: Column, overall: Column, as_of: str) -> DataFrame:
    """keep, field, level, score, issues: one row for each filled field of each record, its accuracy blended with the recogniser's confidence.

    record: the fields that safety.accuracies knows, by name; confidences: a map from fields to numbers, null
    for none; overall: the record's own. A record without a filled field gives no row. The rules are computed
    in a projection, the rows are made from its structs and blended after that: nothing is shuffled.
    """
    rules = safety.accuracies(record, as_of)
    rows = [F.struct(F.lit(n).alias("field"), (text(record[n]) != "").alias("filled"), a["score"].alias("score"), a["issues"].alias("issues"), F.try_element_at(confidences, F.lit(n)).alias("own")) for n, a in rules.items()]
    fields = records.select(*keep, overall.alias("_overall"), F.array(*rows).alias("_fields"))
    each = fields.select(*keep, "_overall", F.explode("_fields").alias("_field")).where("_field.filled")
    b = safety.blended(F.col("_field"), F.col("_field.own"), F.col("_overall"))
    return each.select(*keep, "_field.field", b["level"].alias("level"), b["score"].alias("score"), b["issues"].alias("issues"))


def validated_fields(records: DataFrame, keep: list[str], record: dict[str, Column], as_of: str, confidence: Column | float = 0.85, digits_passed: Column | None = None, zone_valid: Column | None = None, dialect: str = "service", limits: fields.Limits = fields.Limits()) -> DataFrame:  # noqa: B008
    """keep, field, value, raw, confidence, adjusted, valid, needs_review, corrected, repaired_from, issues: one row for each filled field of each record.

    record: the fields of fields.DOCUMENT_FIELDS[dialect] by name; others are not validated, a missing one is empty,
    null and empty fields give no row. Records become rows of (field, value) first, so each rule is evaluated once
    a row, in generated code, however many fields share it. Nothing is shuffled. keep must not hold the names given.
    """
    names = [n for n in fields.DOCUMENT_FIELDS[dialect] if n in record]
    sure = F.lit(confidence) if isinstance(confidence, float) else confidence
    flags = [(F.lit(False) if c is None else F.coalesce(c, F.lit(False))).alias(n) for n, c in (("_passed", digits_passed), ("_zone", zone_valid))]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), text(record[n]).alias("value")) for n in names])).alias("_f")
    long = records.select(*keep, sure.alias("_sure"), *flags, each).where("_f.value <> ''")
    ready = fields.prepared(F.col("_f.field"), F.col("_f.value"), dialect, limits)
    long = long.select("*", *[c.alias(f"_{n}") for n, c in ready.items()])
    v = fields.validated(F.col("_f.field"), F.col("_f.value"), F.col("_sure"), as_of, None, F.col("_passed"), F.col("_zone"), dialect, limits, {n: F.col(f"_{n}") for n in ready})
    found = long.select(*keep, v.alias("_v"))
    valid, review = fields.judged(F.col("_v"), limits)
    shown = [F.col(f"_v.{n}").alias(n) for n in ("field", "value", "raw", "confidence", "adjusted")]
    return found.select(*keep, *shown, valid.alias("valid"), review.alias("needs_review"), *[F.col(f"_v.{n}").alias(n) for n in ("corrected", "repaired_from", "issues")])


#: What a document must have before a form is filled from it.
NEEDED = ("fullName", "passportNumber", "dateOfBirth", "expiryDate", "nationality", "gender")


def document_readiness(validated: DataFrame, key: str, needed: tuple[str, ...] = NEEDED, names: tuple[str, ...] | None = None) -> DataFrame:
    """key, n_fields, overall (the mean adjusted confidence), to_review (sorted fields), ready: one row a document that has a validated field.

    Ready: every needed field is there, and all rows of needed fields are valid and need no review. names: what
    field may be, where that is known; another one is an error then. Names are counted one by one in that case, so
    that a document's aggregate is some numbers, which are hashed; lists of names are objects, for which Spark
    sorts all rows of a task, and spills them. There may be up to 63 needed fields.
    """
    field, review = F.col("field"), F.col("needs_review")
    places = [(field == n, F.lit(1 << k).cast("long")) for k, n in enumerate(needed)]
    place = reduce(lambda c, p: F.when(*p).otherwise(c), reversed(places), F.lit(None).cast("long"))
    fine = F.bool_and(F.when(field.isin(*needed), F.col("valid") & ~review))
    if names is None:
        lists = [F.array_sort(F.collect_list(F.when(review, field))).alias("to_review")]
        to_review = F.col("to_review")
    else:
        known = sorted(set(names))
        other = F.when(~F.coalesce(field.isin(*known), F.lit(False)), F.raise_error(F.concat(F.lit("not among the names: "), text(field)))).cast("long")
        lists = [F.count_if(review & (field == n)).alias(f"_at{k}") for k, n in enumerate(known)] + [F.max(other).alias("_other")]
        to_review = F.flatten(F.array(*[F.array_repeat(F.lit(n), F.col(f"_at{k}").cast("int")) for k, n in enumerate(known)]))
    rows = validated.groupBy(key).agg(F.count("*").alias("n_fields"), F.avg("adjusted").alias("overall"), F.bit_count(F.coalesce(F.bit_or(place), F.lit(0).cast("long"))).alias("_n"), fine.alias("_fine"), *lists)
    shown = [] if names is None else [F.col("_other").isNull().alias("_known")]
    told = rows.select(key, "n_fields", "overall", to_review.alias("to_review"), ((F.col("_n") == len(needed)) & F.coalesce("_fine", F.lit(False))).alias("ready"), *shown)
    return told.where("_known").drop("_known") if shown else told


def field_fixes(records: DataFrame, keep: list[str], record: dict[str, Column], as_of: str, most: int = 5) -> DataFrame:
    """keep, field, rank (from 1), action, code, new_value: the quick fixes of every filled field of record, by the fields' names."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), text(c).alias("value")) for n, c in record.items()])).alias("_f")
    nation = record.get("nationality", F.lit(None).cast("string"))
    long = records.select(*keep, nation.alias("_nation"), each).where("_f.value <> ''")
    fixes = long.select(*keep, F.col("_f.field").alias("field"), F.posexplode(fields.quick_fixes(F.col("_f.field"), F.col("_f.value"), F.col("_nation"), as_of, most)).alias("_at", "_fix"))
    return fixes.select(*keep, "field", (F.col("_at") + 1).alias("rank"), "_fix.action", "_fix.code", F.col("_fix.value").alias("new_value"))
