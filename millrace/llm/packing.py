"""Concatenate and cut: documents laid end to end and cut into windows of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tables import arrow_batches, small, written
from millrace.llm.wordbpe import id_width, token_table


def with_global_start(placed: DataFrame) -> DataFrame:
    """placed(part, before, n_tokens, ...), a written table, with first: the tokens before each row over all parts.

    The second pass: totals by part are one row for each task of the first, and their running sum is the only
    step that sees all parts at once.
    """
    totals = placed.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(totals.select("part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead")), "pack-offsets")
    return placed.join(small(offsets, 16), "part").withColumn("first", F.col("ahead") + F.col("before"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, with with_ids).

    All documents, each with end_id behind it, form one run of tokens that is cut at every multiple of window,
    so every sequence but the last is full and a document lies in as many pieces as windows it touches. start is
    the piece's place in its document, offset that in its sequence. A null or empty text is the single end_id;
    a text longer than a window spans several; repeated rows and null ids are packed as rows of their own; an
    empty table gives no pieces. The order of documents is that of the written token table.
    """
    placed = with_global_start(written(token_table(docs, tokenizer, end_id, id_col, text_col), "pack-tokens"))
    width = id_width(tokenizer)
    arrow_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, first, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                wide = np.frombuffer(ids, dtype=width).astype("<u4")
                n, start = len(wide), 0
                while start < n:
                    at = first + start
                    length = min(n - start, window - at % window)
                    piece = wide[start : start + length].tobytes()
                    row = [doc, start, length, zlib.crc32(piece), n, at // window, at % window, piece]
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
                    start += length
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return placed.select("doc_id", "first", "ids").mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids: the windows put together from pieces that carry ids. A window holds at most its own length in pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
