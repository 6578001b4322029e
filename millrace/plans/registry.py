"""The registered queries and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: No query reads the clock.
AS_OF = "2024-06-01"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt out over all cores by keys, before work that costs more than the move: a file's row group is read by one task, however dear its rows are."""
    spark = rows.sparkSession
    return rows.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def stamp(ts: Column) -> Column:
    """A timestamp as text with microseconds, the same in every engine."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def exact(v: Column, digits: int = 6) -> Column:
    """Rounded at the edge, so that sums in another order agree."""
    return F.round(v, digits)
