"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import bitmaps, free_name, once, small, texts, with_hit, without, written


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts the largest doc_id stays.
    A row goes on to the next, costlier, key only if another row shares its key so far: byte length first,
    then length with a hash of the first characters, then SHA-256 of the whole text. Which lengths, and which
    pairs of length and prefix hash, repeat is told to the tasks by bitmaps of fixed size, so the rounds are the same
    at every size and no text is shuffled; a text alone in its pair is digested only if another pair has its bit.
    Such a text's text_sha256 is null like that of all texts alone after an earlier round, unless digest_all.
    Rows with the same doc_id and text are the same document twice: both are listed, both are kept (use
    unique ids); a doc_id with several texts is judged text by text; a null doc_id never wins against another
    id, and kept is false for it unless its whole group has no id. An empty table gives an empty result. Group
    sizes are counted before any shuffle, so a text that a third of all rows share costs one row per task.
    """
    base = texts(docs, id_col, text_col).withColumn("n", F.octet_length("text"))
    lengths = written(base.groupBy("n").agg(F.count("*").alias("c")).where("c > 1").select("n"), "dedup-lengths")
    by_length = with_hit(base, written(bitmaps(lengths, "n"), "dedup-length-bits"), "again", F.col("n")).withColumn("prefix", F.when(F.col("again"), F.xxhash64(F.substring("text", 1, prefix_chars))))
    prefixes = written(by_length.where("again").groupBy("n", "prefix").agg(F.count("*").alias("c")).where("c > 1").select("n", "prefix"), "dedup-prefixes")
    reached = with_hit(by_length, written(bitmaps(prefixes, "n", "prefix"), "dedup-bits"), "hit", F.col("n"), F.col("prefix")).withColumn("hit", F.col("hit") & F.col("prefix").isNotNull())
    digest = F.sha2("text", 256)
    digests = written(reached.select("doc_id", "n", "prefix", "hit", (digest if digest_all else F.when(F.col("hit"), digest)).alias("text_sha256")), "dedup-digests")
    if not digest_all:
        again = prefixes.withColumn("again", F.lit(True))
        exact = digests.join(small(again, 24), ["n", "prefix"], "left").withColumn("hit", F.coalesce("again", F.lit(False)))
        digests = exact.withColumn("text_sha256", F.when(F.col("hit"), F.col("text_sha256")))
    again = digests.where("hit")
    # SHA-256 decides equality; the written groups let a hot text's rows be split in the join below.
    groups = written(again.groupBy("text_sha256").agg(F.max("doc_id").alias("top"), F.count("*").alias("size")).where("size > 1"), "dedup-groups")
    matched = again.join(small(groups, 120), "text_sha256", "left")
    size = F.coalesce(F.col("size"), F.lit(1)).cast("long")
    found = matched.select("doc_id", F.coalesce(F.col("top"), F.col("doc_id")).alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(F.coalesce(F.col("top"), F.col("doc_id"))).alias("kept"), "text_sha256")
    alone = digests.where("not hit").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return found.unionByName(alone)


def keep_distinct(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each group of equal texts.

    A row goes by its id together with its text, so another text under the same id stays, and of a row that is
    listed several times one stays. Rows without a doc_id go if their text has a row with one; in groups where no
    row has one, all stay.
    """
    verdict = exact_duplicates(docs)
    gone = verdict.where("not kept")
    mark = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    named = without(docs.where("doc_id is not null"), written(gone.where("doc_id is not null").select("doc_id", F.col("text_sha256").alias("mark")).distinct(), "dedup-dropped"), mark)
    own = free_name(docs, "_digest")
    copies = written(gone.where("doc_id is null").select(F.col("text_sha256").alias(own)).distinct(), "dedup-unnamed")
    twice = verdict.where("kept and doc_id is not null and group_size > 1").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    unnamed = docs.where("doc_id is null").withColumn(own, mark)
    return once(named, written(twice, "dedup-listed"), mark).unionByName(unnamed.join(small(copies, 100), own, "left_anti").drop(own))
