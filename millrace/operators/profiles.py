"""Fill profiles and their field mappings: one default, edits by key, defaults for what is invalid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_default(profiles: DataFrame, chosen: str | int, as_of: str) -> DataFrame:
    """Exactly the chosen profile is the default, if there is one of that id; all are written anew at as_of."""
    return profiles.withColumns({"is_default": F.coalesce(F.col("id") == F.lit(chosen), F.lit(False)), "updated_at": F.lit(as_of)})


def with_profile(profiles: DataFrame, profile_id: str | int, name: str, as_of: str, target: str = "copy_assistant") -> DataFrame:
    """One more profile, without mappings; the first one of an empty table is the default."""
    new = profiles.sparkSession.range(1).select(F.lit(profile_id).alias("id"), F.lit(name).alias("name"), F.lit(target).alias("target"), F.lit(profiles.isEmpty()).alias("is_default"), F.lit(as_of).alias("updated_at"))
    return profiles.unionByName(new, allowMissingColumns=True)


def edited_mappings(mappings: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """mappings, keyed by profile_id and mapping_id, after edits (op: add, update or remove; at: their order; fields).

    The last edit of a mapping counts. An update of a mapping that is not there, or no more, changes nothing, nor does
    its removal; adding one that is there replaces it. An edit without a known op, or with a null key, is none.
    Ties of at count add first, then update, then remove.
    """
    keys = ["profile_id", "mapping_id"]
    base = mappings.select(*keys, F.struct(*fields).alias("_old"))
    rank = F.array_position(F.array(*map(F.lit, ("add", "update", "remove"))), F.col("op"))
    e = edits.where(rank > 0).dropna(subset=keys).select(*keys, "op", F.struct(F.col("at"), rank.alias("rank")).alias("_at"), F.struct(*fields).alias("_new"))
    e = e.join(base.select(*keys, F.lit(True).alias("_there")), keys, "left")
    of = Window.partitionBy(*keys)
    e = e.withColumn("_gone", F.max(F.when(F.col("op") == "remove", F.col("_at"))).over(of))
    after = F.col("_gone").isNull() | (F.col("_at") > F.col("_gone"))
    e = e.withColumn("_added", F.min(F.when((F.col("op") == "add") & after, F.col("_at"))).over(of))
    counts = (F.col("op") != "remove") & after & ((F.col("_there") & F.col("_gone").isNull()) | (F.col("_at") >= F.col("_added")))
    last = e.groupBy(*keys).agg(F.max_by(F.when(counts, F.col("_new")), F.when(counts, F.col("_at"))).alias("_new"), F.max("_gone").isNotNull().alias("_removed"))
    both = base.join(last, keys, "full")
    kept = F.when(F.col("_new").isNotNull(), F.col("_new")).when(~F.coalesce("_removed", F.lit(False)), F.col("_old"))
    return both.select(*keys, kept.alias("_m")).where("_m is not null").select(*keys, "_m.*")


def mappings_or_defaults(profiles: DataFrame, mappings: DataFrame, defaults: list[dict], known: list[str]) -> DataFrame:
    """profile_id, source, target, required, enabled, stored: a profile's own mappings, or the defaults where these are invalid.

    They are invalid if there are none, a target is blank, a source is not among known, or a source has two.
    """
    bad = (F.trim(F.coalesce("target", F.lit(""))) == "") | ~F.coalesce(F.col("source").isin(*known), F.lit(False))
    each = mappings.groupBy("profile_id", "source").agg(F.count("*").alias("n"), F.max(bad).alias("bad"))
    sound = each.groupBy("profile_id").agg((F.max(F.col("bad") | (F.col("n") > 1))).alias("bad")).where("not bad").select("profile_id")
    names = ["source", "target", "required", "enabled"]
    own = mappings.join(sound, "profile_id", "left_semi").select("profile_id", *names, F.lit(True).alias("stored"))
    rows = F.array(*[F.struct(*[F.lit(d.get(k, d["source"] if k == "target" else k == "enabled")).alias(k) for k in names]) for d in defaults])
    rest = profiles.select(F.col("id").alias("profile_id")).join(sound, "profile_id", "left_anti").select("profile_id", F.explode(rows).alias("_d"))
    return own.unionByName(rest.select("profile_id", "_d.*", F.lit(False).alias("stored")))
