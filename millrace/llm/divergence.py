"""How far the sources of a language diverge in their words: all pairs of sources in two-dimensional tiles of packed count vectors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tables import arrow_batches, small, written

#: Letters of ASCII and all bytes of other characters: over UTF-8 the same words as [^\x00-\x40\x5B-\x60\x7B-\x7F]+ over code points.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
SCALE, SMOOTHING = 1_000_000_000, 5
#: Groups in a block; terms in a chunk of the vocabulary, on average; chunks that one task goes through; terms that a task holds while it counts.
BLOCK, CHUNK, SPAN, HELD = 16, 1 << 15, 8, 200_000


def share(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * counts / total), exact in 64 bits: three digits to the base of a thousand."""
    out, rest = np.zeros_like(counts), counts
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // total, rest * 1000 % total
    return out + 1


def _share_sql(count: str, total: str) -> str:
    """The same as a Spark expression; count and total are longs."""
    first, second = f"(({count}) * 1000)", f"((({count}) * 1000 % ({total})) * 1000)"
    third = f"(({second} % ({total})) * 1000)"
    return f"1 + ({first} div ({total})) * 1000000 + ({second} div ({total})) * 1000 + ({third} div ({total}))"


def tally(docs: DataFrame) -> DataFrame:
    """docs(text, lang, source) without nulls: lang, source, term, n (occurrences), docs, summed within each task, then over all."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_of) in seen.items():
                terms = list(n)
                for k in range(0, len(terms), 20_000):
                    own = terms[k : k + 20_000]
                    columns = [pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array([t.decode() for t in own]), pa.array([n[t] for t in own], pa.int64()), pa.array([docs_of[t] for t in own], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            seen.clear()

        for b in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = TERM.findall(text.encode("utf-8", "replace").lower())
                n, docs_of = seen.setdefault((lang, source), (Counter(), Counter()))
                n.update(words)
                docs_of.update(set(words))
            if sum(len(n) for n, _ in seen.values()) > HELD:
                yield from rows()
        yield from rows()

    counted = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _tiles(vectors: DataFrame) -> DataFrame:
    """vectors(lang, g, blocks, chunk, width, total, at, n), one row for each group and chunk: lang, a, b, value for each pair a < b of groups.

    A group's vector goes to each tile, a pair of blocks, that its block is in. A task is a tile with SPAN successive
    chunks; it holds two blocks of vectors of one chunk at a time, and their sums.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    own = (F.col("g") / BLOCK).cast("int")
    dealt = vectors.withColumn("other", other).select("lang", F.least(own, "other").alias("i"), F.greatest(own, "other").alias("j"), (F.col("chunk") / SPAN).cast("int").alias("span"), "chunk", "g", "width", "total", "at", "n")
    key = ["lang", "i", "j", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, chunk, held, sums = None, None, {}, {}

        def add() -> None:
            """The sums over the chunk that is held."""
            _, i, j, _ = tile
            p = {}
            for g, (width, total, at, n) in held.items():
                counts = np.full(width, SMOOTHING, dtype=np.int64)
                counts[at] += n
                p[g] = share(counts, total) if width else counts
            of_j = sorted(g for g in p if g // BLOCK == j)
            whole = np.stack([p[g] for g in of_j]) if of_j else None
            for a in sorted(g for g in p if g // BLOCK == i):
                for b, value in zip(of_j, np.abs(whole - p[a]).sum(axis=1).tolist() if of_j else [], strict=True):
                    if a < b:
                        sums[a, b] = sums.get((a, b), 0) + value
            held.clear()

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([tile[0]] * len(sums), pa.string()), pa.array([a for a, _ in sums], pa.int32()), pa.array([b for _, b in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], ["lang", "a", "b", "value"])
            sums.clear()
            return out

        for batch in batches:
            lists = {c: batch.column(c) for c in ("at", "n")}
            plain = {c: batch.column(c).to_pylist() for c in (*key, "chunk", "g", "width", "total")}
            for k in range(batch.num_rows):
                now = tuple(plain[c][k] for c in key)
                if (now, plain["chunk"][k]) != (tile, chunk):
                    if tile is not None:
                        add()
                    if tile not in (None, now):
                        yield done()
                    tile, chunk = now, plain["chunk"][k]
                held[plain["g"][k]] = (plain["width"][k], plain["total"][k], lists["at"][k].values.to_numpy(), lists["n"][k].values.to_numpy())
        if tile is not None:
            add()
            yield done()

    ordered = dealt.repartition(*key).sortWithinPartitions(*key, "chunk", "g")
    parts = ordered.mapInArrow(run, "lang string, a int, b int, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how far apart the word shares of each source are from those of others.

    A lang keeps the terms that at least min_docs of its documents have; a group is a lang and a source, and the
    share of a kept term there is 1 + floor(10^9 (count + 5) / (N + 5 V)), for N occurrences of V kept terms.
    Part pair: item is another source of the lang, value the sum over kept terms of the difference in shares, all
    ranks. Part term: item is a kept term of the group whose share is over that of the whole lang, value the
    difference, ranks up to top. Ranks go by value, largest first, then by the item's bytes.

    Null text, lang and source are empty ones; groups without a term take part; where no term is kept all pairs have
    value 0. Repeated rows count each. Other columns stay out; an empty table gives no rows. The result has a row
    for each pair of sources of a lang, and so grows with their square; everything else is counted in the map
    tasks first, so that a source with a third of all rows is a few vectors like any other.
    """
    arrow_batches(docs.sparkSession)
    base = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = written(base.select("lang", "source").distinct().select("lang", "source", (F.row_number().over(by_source) - 1).alias("g")), "divergence-groups")
    counted = written(tally(base), "divergence-counts")
    kept = written(counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= min_docs).select("lang", "term", "n_lang"), "divergence-kept")
    langs = groups.groupBy("lang").agg(F.count("*").alias("of")).join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("n_lang")), "lang", "left")
    langs = written(langs.select("lang", F.ceil(F.col("of") / BLOCK).cast("int").alias("blocks"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("n_lang", F.lit(0)).alias("all_lang")), "divergence-langs")
    most = langs.agg(F.max("terms")).first()[0] or 0
    chunks = max(1, -(-most // CHUNK))
    place = Window.partitionBy("lang", "chunk").orderBy("term")
    numbered = kept.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")).select("lang", "term", "n_lang", "chunk", (F.row_number().over(place) - 1).alias("at"))
    numbered = written(numbered, "divergence-terms")
    own = written(counted.join(small(numbered, 64), ["lang", "term"]).select("lang", "source", "term", "chunk", "at", "n", "n_lang"), "divergence-own")
    totals = groups.join(own.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(small(langs, 40), "lang")
    totals = written(totals.select("lang", "source", "g", "blocks", (F.coalesce("total", F.lit(0)) + SMOOTHING * F.col("terms")).alias("total"), (F.col("all_lang") + SMOOTHING * F.col("terms")).alias("total_lang")), "divergence-totals")

    widths = numbered.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("width"))
    packed = own.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("held"))  # a chunk's terms at most
    every = totals.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(small(written(widths, "divergence-widths"), 24), ["lang", "chunk"], "left")
    vectors = every.join(packed, ["lang", "source", "chunk"], "left").select("lang", "g", "blocks", "chunk", F.coalesce("width", F.lit(0)).alias("width"), "total", F.coalesce(F.col("held.at"), F.array().cast("array<int>")).alias("at"), F.coalesce(F.col("held.n"), F.array().cast("array<long>")).alias("n"))
    pairs = written(_tiles(vectors), "divergence-pairs")
    names = small(totals.select("lang", F.col("g").alias("a"), F.col("source").alias("one")), 40)
    others = small(totals.select("lang", F.col("g").alias("b"), F.col("source").alias("two")), 40)
    named = pairs.join(names, ["lang", "a"]).join(others, ["lang", "b"])
    both = named.select("lang", F.col("one").alias("source"), F.col("two").alias("item"), "value").unionByName(named.select("lang", F.col("two").alias("source"), F.col("one").alias("item"), "value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = both.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(best))

    known = own.join(small(totals.select("lang", "source", "total", "total_lang"), 64), ["lang", "source"])
    p, q = F.expr(_share_sql(f"n + {SMOOTHING}", "total")), F.expr(_share_sql(f"n_lang + {SMOOTHING}", "total_lang"))
    over = known.where("n > 0").select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    term = over.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return pair.unionByName(term).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
