"""Order-dependent operators: smoothing, runs, sessions, neighbours, running counts and first occurrences. All are keyed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_average(rows: DataFrame, by: list[str], order: str, value: str, width: int, out: str = "smooth") -> DataFrame:
    """Centred mean over width // 2 rows to either side, fewer at the ends."""
    half = width // 2
    return rows.withColumn(out, F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)))


def bands(rows: DataFrame, by: list[str], order: str, value: str, threshold: float, least: int = 2) -> DataFrame:
    """Maximal runs of rows with value >= threshold, least rows long: first and last order value, length, peak. A null value ends a run."""
    w = Window.partitionBy(*by).orderBy(order)
    inside = F.coalesce(F.col(value) >= threshold, F.lit(False))
    marked = rows.withColumn("_in", inside).withColumn("_run", F.sum(F.when(~inside, 1).otherwise(0)).over(w))
    runs = marked.where("_in").groupBy(*by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"), F.max(value).alias("peak"))
    return runs.where(F.col("length") >= least).drop("_run")


def sessions(rows: DataFrame, by: list[str], order: Column, gap: Column | float, out: str = "session") -> DataFrame:
    """Numbers groups within by from 1: a new one begins where order grows by more than gap."""
    w = Window.partitionBy(*by).orderBy("_at")
    placed = rows.withColumn("_at", order)
    started = F.coalesce((F.col("_at") - F.lag("_at").over(w) > gap).cast("int"), F.lit(0))
    return placed.withColumn("_new", started).withColumn(out, F.sum("_new").over(w) + 1).drop("_new", "_at")


def adjacent(rows: DataFrame, by: list[str], order: list[str], value: str, out: str = "following") -> DataFrame:
    """Each row with the value of the next one of its group; the last of a group goes."""
    return rows.withColumn(out, F.lead(value).over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out).isNotNull())


def counts_before(rows: DataFrame, by: list[str], order: list[str], tests: dict[str, Column]) -> DataFrame:
    """For each test, how many earlier rows of the group meet it."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({name: F.coalesce(F.sum(F.when(test, 1).otherwise(0)).over(w), F.lit(0)) for name, test in tests.items()})


def duplicates(rows: DataFrame, key: Column, order: list[str], out: str = "duplicate") -> DataFrame:
    """Marks rows whose non-empty key came before, in order; blank keys are no duplicates and are not sorted."""
    marked = rows.withColumn("_key", key)
    blank = F.coalesce(F.col("_key"), F.lit("")) == ""
    w = Window.partitionBy("_key").orderBy(*order)
    return marked.where(~blank).withColumn(out, F.row_number().over(w) > 1).unionByName(marked.where(blank).withColumn(out, F.lit(False))).drop("_key")


def materialised(rows: DataFrame, out: str, value: Column) -> DataFrame:
    """rows with value under the name out, computed once however often it is read: the optimiser copies no expression across a generator."""
    return rows.select("*", F.explode(F.array(value)).alias(out))


def neighbours(rows: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """previous and next key, each row's own at the ends."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumns({"previous": F.coalesce(F.lag(key).over(w), F.col(key)), "next": F.coalesce(F.lead(key).over(w), F.col(key))})


def upper_median(values: Column) -> Column:
    """The middle of an array, the upper one of two, null if empty."""
    ordered = F.array_sort(values)
    return F.try_element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1)


#: Parts that a group's values are counted in before those around its middle are looked at.
PARTS = 4096


def upper_medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, middle: rows of each group and the value at place floor(n / 2) + 1, NaN behind all numbers and nulls behind NaN.

    Equal values are counted first, then the counts of equal stretches between a group's least and greatest
    number are summed, and only the stretch that holds the place is ordered; no task holds a group's values.
    """
    v, keys = F.col("_v"), [f"_k{k}" for k in range(len(by))]
    counts = rows.groupBy(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    number = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v / 2)
    groups = counts.groupBy(*keys).agg(F.sum("_c").alias("n"), F.min(number).alias("_low"), (F.max(number) - F.min(number)).alias("_span"))
    ends = F.when(v.isNull(), PARTS + 3).when(F.isnan(v), PARTS + 2).when(v == float("inf"), PARTS + 1).when(v == float("-inf"), -1)
    part = ends.when(F.col("_span") > 0, F.floor((v / 2 - F.col("_low")) / F.col("_span") * PARTS)).otherwise(0)

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """Null keys are a group too."""
        renamed = right.withColumnsRenamed({k: f"{k}_r" for k in on})
        both = [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in on]
        return left.join(renamed, both).drop(*[f"{k}_r" for k in on])

    placed = joined(counts, groups, keys).select(*keys, "n", "_v", "_c", part.cast("long").alias("_part"))
    sums = placed.groupBy(*keys, "_part").agg(F.first("n").alias("n"), F.sum("_c").alias("_c"))
    middle = F.floor(F.col("n") / 2) + 1
    held = sums.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part")))
    held = held.where((F.col("_upto") >= middle) & (F.col("_upto") - F.col("_c") < middle)).select(*keys, "_part", (F.col("_upto") - F.col("_c")).alias("_before"))
    inside = joined(placed, held, [*keys, "_part"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys).orderBy(v.asc_nulls_last()))
    found = inside.withColumn("_upto", upto).where((F.col("_upto") >= middle) & (F.col("_upto") - F.col("_c") < middle))
    return found.select(*[F.col(k).alias(b) for b, k in zip(by, keys, strict=True)], "n", v.alias("middle"))


def best(rows: DataFrame, by: list[str], score: str, order: list[str], n: int = 1) -> DataFrame:
    """The n rows of each group with the highest score; order decides ties."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), *order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
