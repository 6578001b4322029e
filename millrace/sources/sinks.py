"""Sinks: sheets as tables, logs as lines, upserts, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_sheets(sheets: dict[str, DataFrame], path: str, kind: str = "csv") -> None:
    """One folder for each sheet, with a header, nulls as empty text."""
    for name, rows in sheets.items():
        plain = rows.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])
        writer = plain.write.mode("overwrite")
        (writer.option("header", True).option("escape", '"').csv(f"{path}/{name}") if kind == "csv" else writer.format(kind).save(f"{path}/{name}"))


def read_sheet(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("emptyValue", "").csv(f"{path}/{name}").na.fill("")


def upserted(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """table with changes over it by key, of several changes the last by order; changes have the table's columns and order."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    newest = changes.withColumn("_rank", last).where("_rank = 1").select(table.columns)
    return table.join(newest.select(key), key, "left_anti").select(table.columns).unionByName(newest)


def removed(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti").select(table.columns)


def write_version(rows: DataFrame, root: str, version: int) -> str:
    """A table version in a folder of its own: readers of the last one are not disturbed, and a failed write leaves it as it was."""
    path = f"{root}/v{version:06d}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    return rows.select(F.to_json(F.struct("*")).alias(name))


def response(rows: DataFrame, job: str, status: str, errors: str) -> DataFrame:
    """One envelope for each job: its rows by status, and its errors' codes in order. Errors are as many as a job's failed files."""
    failed = F.array_sort(F.collect_list(F.when(F.col(errors).isNotNull(), F.col(errors))))
    return rows.groupBy(job).agg(F.count("*").alias("total"), F.count_if(F.col(status) == "FAILED").alias("failed"), failed.alias("errors")).withColumn("status", F.when(F.col("failed") == F.col("total"), "FAILED").when(F.col("failed") > 0, "PARTIAL").otherwise("SUCCESS"))
