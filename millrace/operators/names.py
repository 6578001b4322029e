"""Names that may be one person's, found by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx


def _div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("int")


def _classes(names: DataFrame, by: Column, where: Column) -> DataFrame:
    """Each name with the least one of its class, but for that one itself."""
    first = F.min("x").over(Window.partitionBy("_by"))
    return names.where(where).withColumn("_by", by).select("x", first.alias("y")).where("x > y")


def _close(names: DataFrame) -> DataFrame:
    """All pairs, y the shorter or equally long and lesser name, at most three edits for ten characters of the longer.

    Where k edits suffice, one of k + 1 pieces of the shorter name stands unchanged in the longer one, moved by no more
    than the edits to its left and right allow. So pieces meet places by an equi-join, no pair is lost, and the
    distance is computed for pairs that met.
    """
    n = F.length("x")
    pieces = names.withColumn("n", n).withColumn("k", F.explode(F.sequence(_div(n * 3, 10), _div(_div(n * 10, 7) * 3, 10)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    begin, end = _div(F.col("i") * F.col("n"), F.col("k") + 1), _div((F.col("i") + 1) * F.col("n"), F.col("k") + 1)
    pieces = pieces.select(F.col("x").alias("y"), "n", "k", "i", F.substring("x", begin + 1, end - begin).alias("piece"))

    # Every place where a piece of a name of n characters may stand: its own, moved by -(k - d) / 2 to (k + d) / 2, d the names' difference in length.
    places = names.withColumn("k", _div(n * 3, 10)).withColumn("n", F.explode(F.sequence(F.greatest(n - F.col("k"), F.lit(1)), n))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    places = places.withColumn("at", begin).withColumn("size", end - begin).withColumn("d", F.length("x") - F.col("n"))
    places = places.withColumn("at", F.explode(F.sequence(F.col("at") - _div(F.col("k") - F.col("d"), 2), F.col("at") + _div(F.col("k") + F.col("d"), 2))))
    places = places.where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.length("x")))
    places = places.select("x", "n", "k", "i", F.substring("x", F.col("at") + 1, F.col("size")).alias("piece")).distinct()

    met = places.join(pieces, ["n", "k", "i", "piece"]).where((F.length("x") > F.col("n")) | (F.col("x") > F.col("y"))).select("x", "y").distinct()
    return met.where(F.levenshtein("x", "y") * 10 <= F.length("x") * 3)


def similar_names(rows: DataFrame, name: str) -> DataFrame:
    """name, other, similarity, method: the names of a table that fuzzy_match matches, each pair once, other not the greater text.

    Names count trimmed and in capitals, equal ones once; null and empty ones match nothing. Alike in sound or
    equal without marks is told by classes: each name with the least of its class. Pairs whose names are in one such
    class are left out beyond that; every other matching pair is a row. A piece that very many different names share
    makes as many pairs to look at; adaptive execution splits such keys.
    """
    names = rows.select(F.upper(F.trim(F.col(name))).alias("x")).where("x <> ''").distinct()
    sound, bare = tx.soundex(F.col("x")), tx.strip_diacritics(F.col("x"))
    alike = _classes(names, bare, F.lit(True)).unionByName(_classes(names, sound, F.length("x") >= 3)).distinct()
    ordered = _close(names).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    close = ordered.withColumn("_m", tx.fuzzy_match(F.col("x"), F.col("y"))).where(F.col("_m")["method"] == "levenshtein")
    both = alike.withColumn("_m", tx.fuzzy_match(F.col("x"), F.col("y"))).unionByName(close)
    return both.select(F.col("x").alias("name"), F.col("y").alias("other"), F.col("_m")["similarity"].alias("similarity"), F.col("_m")["method"].alias("method"))
