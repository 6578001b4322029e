"""Shared plumbing: written intermediate tables, size-checked broadcasts, sets of bounded size, samples, Arrow batch sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows, at the stated bytes a row, stay under this.
BROADCAST_BYTES = 24 << 20
#: What a row costs in the broadcast relation beside its own bytes: pointers, key and row header.
ROW_OVERHEAD = 40
#: Bits of a bitmap of hashes: 4,096 rows of 4 KB, 16 MB however many keys are in it.
BITMAP_BITS = 1 << 27


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session takes a folder of its own; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints/millrace"
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there, and lost executors cost no recomputation beyond it."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, row_bytes: int, limit: int | None = None) -> bool:
    """Whether df, counted, may be broadcast. Call it on written tables, whose count is metadata."""
    return df.count() * (row_bytes + ROW_OVERHEAD) <= (BROADCAST_BYTES if limit is None else limit)


def small(df: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """df marked for broadcast if its counted size is under the limit, else df as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df, row_bytes, limit) else df


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with more underscores, that df has no column of, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _place(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITMAP_BITS)) + 1


def bitmaps(df: DataFrame, *keys: str) -> DataFrame:
    """bucket, bits: which hashes of these keys occur in df; BITMAP_BITS bits at most, so it may always be broadcast."""
    place = _place(*map(F.col, keys))
    return df.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def with_hit(df: DataFrame, found: DataFrame, name: str, *keys: Column) -> DataFrame:
    """df with the boolean column name: false only for rows whose keys bitmaps did not see. Null keys hash like values."""
    bucket, bits = free_name(df, "_bucket"), free_name(df, "_bits")
    place = _place(*keys)
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    joined = df.withColumn(bucket, F.bitmap_bucket_number(place)).join(F.broadcast(found.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))), bucket, "left")
    return joined.withColumn(name, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(bucket, bits)


def sampled(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most rows rows of the written table df, those with the least hashes of key (a long): a filter on the hash, by the count, leaves few more than that to be sorted."""
    n, spread = max(df.count(), 1), 1 << 30
    share = min(1.0, (1.2 * rows + 100) / n)
    return df.where(F.pmod(F.xxhash64(key), F.lit(spread)) < int(share * spread)).orderBy(F.pmod(F.xxhash64(key), F.lit(spread)), key).limit(rows)


def arrow_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, by rows and bytes; the same for all operators, as results are lazy and the setting is the session's."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators need, under fixed names, null texts as empty; other columns, whatever their names, stay out."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def without(docs: DataFrame, dropped: DataFrame, mark: Column, id_col: str = "doc_id") -> DataFrame:
    """docs, with all their columns, minus the rows whose id and mark, a digest of their text, are in the written table dropped(doc_id, mark).

    Should dropped be too large to broadcast, only rows that its bitmap may know are shuffled.
    """
    key, own, other = free_name(docs, "_id"), free_name(docs, "_mark"), free_name(docs, "_dropped_mark")
    gone = dropped.select(F.col("doc_id").alias(key), F.col("mark").alias(other))
    same = (F.col(f"`{id_col}`") == F.col(key)) & (F.col(own) == F.col(other))
    marked = docs.withColumn(own, mark)
    row_bytes = 16 if dict(dropped.dtypes)["mark"] == "bigint" else 96
    if is_small(gone, row_bytes):
        return marked.join(F.broadcast(gone), same, "left_anti").drop(own)
    hit = free_name(marked, "_hit")
    tried = with_hit(marked, written(bitmaps(dropped, "doc_id", "mark"), "dropped-bits"), hit, F.col(f"`{id_col}`").cast("long"), F.col(own))
    kept = tried.where(F.col(hit)).join(gone, same, "left_anti").unionByName(tried.where(~F.col(hit)))
    return kept.drop(own, hit)


def once(docs: DataFrame, listed: DataFrame, mark: Column, id_col: str = "doc_id") -> DataFrame:
    """docs, with all their columns, where of rows with one id and one mark a single one stays, for the ids in the written table listed(doc_id).

    Only rows whose id the bitmap of listed may know are shuffled, and each task sends one of its equal rows at most.
    Which of them stays is open where their other columns differ. Rows without an id stay as they are.
    """
    hit, own = free_name(docs, "_hit"), free_name(docs, "_mark")
    tried = with_hit(docs, written(bitmaps(listed, "doc_id"), "listed-bits"), hit, F.col(f"`{id_col}`").cast("long"))
    again = F.col(hit) & F.col(f"`{id_col}`").isNotNull()
    single = tried.where(again).withColumn(own, mark).dropDuplicates([id_col, own]).drop(own, hit)
    return single.unionByName(tried.where(~again).drop(hit))
