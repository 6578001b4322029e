"""Written tables in the folder that driver and executors share, logs stored by day, and tables laid out by key."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; a local session without one has a folder of its own, a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints/millrace"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(rows: DataFrame, label: str) -> DataFrame:
    """rows written once and read back, so that what follows neither recomputes them nor depends on an executor that held them."""
    path = shared_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _folders(spark: SparkSession, path: str, column: str) -> dict[str, object]:
    """value: folder, of a table partitioned by column; the file system is that of the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return {}
    found = (f.getPath() for f in files.listStatus(where) if f.isDirectory())
    return {p.getName().partition("=")[2]: p for p in found if p.getName().startswith(f"{column}=")}


def write_log(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Append events to the log at path, one folder for each day. A day's rows come from as many tasks as they fill, so one busy day is not one task."""
    events.withColumn("day", F.to_date(F.col(ts))).write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """The log, with its day. A log that may have lost all its rows is read with the columns of like."""
    return spark.read.schema(like.withColumn("day", F.lit(None).cast("date")).schema).parquet(path) if like is not None else spark.read.parquet(path)


def by_type(log: DataFrame, session: object, kind: str, session_col: str = "user_id", kind_col: str = "event_type") -> DataFrame:
    """A session's entries of one type; both tests reach the scan."""
    return log.where((F.col(session_col) == session) & (F.col(kind_col) == kind))


def expire(spark: SparkSession, path: str, as_of: str, days: int = 90, ts: str = "ts") -> int:
    """Delete what is older than so many days before as_of from the log at path; give the number of folders that went.

    Folders of days that are all too old are deleted as they are. Of the day that the limit falls in, the rows
    that stay are written elsewhere and then put in its place by a dynamic overwrite; no other folder is touched.
    A row without a time is in no day's folder and stays, as it has no age.
    """
    kind = read_log(spark, path).schema[ts].dataType
    limit = F.lit(as_of).cast(kind) - F.expr(f"INTERVAL {int(days)} DAYS")
    day = spark.range(1).select(F.to_date(limit).cast("string")).first()[0]
    folders = _folders(spark, path, "day")
    gone = [p for name, p in folders.items() if name < day]
    for p in gone:
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if day in folders:
        edge = written(read_log(spark, path).where((F.col("day") == F.lit(day).cast("date")) & (F.col(ts) >= limit)), "log-edge")
        if edge.isEmpty():
            folders[day].getFileSystem(spark._jsc.hadoopConfiguration()).delete(folders[day], True)
            gone.append(folders[day])
        else:
            edge.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return len(gone)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def write_keyed(rows: DataFrame, path: str, key: str, buckets: int = 64, indexes: tuple[str, ...] = ()) -> None:
    """rows laid out by key: a folder for each bucket of the key's hash, sorted by key, and for each of indexes a
    table of its values with the buckets that hold them, laid out by value. A null key has a bucket like others."""
    placed = rows.withColumn("_bucket", _bucket(F.col(key), buckets))
    placed.repartition(buckets, "_bucket").sortWithinPartitions(key).write.partitionBy("_bucket").parquet(f"{path}/rows")
    for column in indexes:
        pairs = placed.select(F.col(column).alias("value"), F.col("_bucket").alias("holds")).where("value is not null").distinct()
        pairs.withColumn("_bucket", _bucket(F.col("value"), buckets)).repartition(buckets, "_bucket").write.partitionBy("_bucket").parquet(f"{path}/by-{column}")


def by_key(spark: SparkSession, path: str, key: str, value: object, buckets: int = 64) -> DataFrame:
    """The rows with that key: the hash of a literal is a constant, so only one folder's files are opened, and in them the row groups that can hold it."""
    rows = spark.read.parquet(f"{path}/rows")
    wanted = F.lit(value).cast(rows.schema[key].dataType)
    return rows.where((F.col("_bucket") == _bucket(wanted, buckets)) & (F.col(key) == wanted)).drop("_bucket")


def by_index(spark: SparkSession, path: str, column: str, value: object, buckets: int = 64) -> DataFrame:
    """The rows with that value of an indexed column: the index's folder names the buckets, as many as there are at most, and only these are opened."""
    rows, index = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/by-{column}")
    wanted = F.lit(value).cast(rows.schema[column].dataType)
    held = index.where((F.col("_bucket") == _bucket(wanted, buckets)) & (F.col("value") == wanted)).select("holds").distinct()
    return rows.where(F.col("_bucket").isin([r[0] for r in held.collect()]) & (F.col(column) == wanted)).drop("_bucket")
