"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import small, written


def _least(edges: DataFrame) -> DataFrame:
    """For each node u of edges(u, v): the smallest of u and its neighbours. Summed in each task before the shuffle, so a hub is cheap."""
    return written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of links; nodes without links are not listed.

    Rows with a null end, loops and repeated links change nothing; no links give no rows. Each round writes its
    edges to the shared folder; rounds grow with the logarithm of the longest path. A hub's edges are split by
    the join (both sides come from written tables) or met by a broadcast of counted size.
    """
    pair = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = written(pair.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc-edges")
    mark = _mark(edges)
    while mark[0]:
        # Large star: each node hands its larger neighbours to the smallest node it knows.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _least(both)
        moved = both.where("v > u").join(small(near, 32), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(moved.distinct(), "cc-large")
        # Small star: each node hands its smaller neighbours, and itself, to the smallest of them.
        near = _least(large)
        moved = large.join(small(near, 32), "u")
        edges = written(moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
