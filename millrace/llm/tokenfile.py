"""Token-id files: canonical length-limited Huffman blocks with bit-offset checkpoints, decoded by table."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.packing import with_global_start
from millrace.llm.tables import arrow_batches, fresh_path, written
from millrace.llm.wordbpe import id_width, token_table

#: Ids in a block, at most; ids between two checkpoints of a block.
BLOCK, CHECKPOINT = 1 << 18, 256
MAX_BITS = 16


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits of each symbol in an optimal prefix code of at most limit bits (package-merge); 0 for a count of zero."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        bits[used] = 1
        return bits
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    levels, weight = [], leaf
    for _ in range(limit - 1):
        pairs = weight[: len(weight) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaf, pairs])
        at = np.argsort(merged, kind="stable")
        levels.append(at < len(leaf))
        weight = merged[at]
    # Walk back: how many of each level's first items are taken; a package stands for two items of the level before.
    take, depth = 2 * len(leaf) - 2, np.zeros(len(leaf), dtype=np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    depth[:take] += 1
    bits[order] = depth
    return bits


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol."""
    codes, code, last = np.zeros(len(bits), dtype=np.uint32), 0, 0
    for length in range(1, int(bits.max(initial=0)) + 1):
        code <<= length - last
        last = length
        of = np.flatnonzero(bits == length)
        codes[of] = code + np.arange(len(of), dtype=np.uint32)
        code += len(of)
    return codes


def encode_block(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream, in 32-bit words from the high bit down, and the bit offset of every CHECKPOINT-th id."""
    n_bits = bits[ids].astype(np.int64)
    ends = np.cumsum(n_bits)
    at = ends - n_bits
    words = np.zeros(int(ends[-1] if len(ends) else 0) // 32 + 3, dtype=np.uint64)
    if len(ids):
        shifted = codes[ids].astype(np.uint64) << (64 - (at & 31) - n_bits).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] |= np.add.reduceat(shifted >> np.uint64(32), first)
        low = shifted & np.uint64(0xFFFFFFFF)
        over = np.flatnonzero(low)
        words[word[over] + 1] |= low[over]
    return words.astype(">u4").tobytes(), at[::CHECKPOINT]


def decode_tables(bits: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next width bits: the symbol and its bits."""
    width = int(bits.max(initial=1))
    symbol, length = np.zeros(1 << width, dtype=np.uint32), np.zeros(1 << width, dtype=np.int64)
    for s in np.flatnonzero(bits):
        span = width - int(bits[s])
        at = int(codes[s]) << span
        symbol[at : at + (1 << span)] = s
        length[at : at + (1 << span)] = bits[s]
    return symbol, length, width


def decode_block(stream: bytes, starts: np.ndarray, n: int, tables: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """All checkpoints at once, one id each a step."""
    symbol, length, width = tables
    words = np.frombuffer(stream, dtype=">u4").astype(np.uint64)
    double = (words[:-1] << np.uint64(32)) | words[1:]
    at, out = starts.astype(np.int64), np.zeros((len(starts), CHECKPOINT), dtype=np.uint32)
    top, mask = len(double) - 1, np.uint64((1 << width) - 1)
    for step in range(min(CHECKPOINT, n)):
        if step and step == n - (len(starts) - 1) * CHECKPOINT:
            at = at[:-1]  # the last run is over
        peek = (double[np.minimum(at >> 5, top)] >> (64 - width - (at & 31)).astype(np.uint64)) & mask
        out[: len(at), step] = symbol[peek]
        at = at + length[peek]
    return out.ravel()[:n]


def write_token_file(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write docs' ids, each document with end_id behind it, in ascending doc_id; give the file set's path.

    path/book holds each used id with its code length: canonical codes follow from these. path/blocks holds
    one row per block: part, before (ids of the part's earlier blocks), n_tokens, docs, lengths, earlier (ids of
    the first document in blocks before), later (of the last one in blocks behind), stream (Huffman bits) and
    checkpoints (a bit offset for every CHECKPOINT ids). A block holds BLOCK ids at most and decodes with the book
    alone; a long document goes on in the next block. Rows are committed by Spark, so a lost executor leaves no
    half-written file. Null texts count as empty, null doc_ids come first, repeated ids lie side by side; an
    empty table has no blocks.
    """
    spark, path, width = docs.sparkSession, fresh_path(docs.sparkSession, "token-file"), id_width(tokenizer)
    tokens = written(token_table(docs, tokenizer, end_id, id_col, text_col).select("doc_id", "ids"), "token-ids")
    size = 1 << 16 if width == "<u2" else 1 << 20

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=width), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    # One row for each id of the vocabulary, at most, reaches the driver.
    counted = tokens.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, dtype=np.int64)
    counts[counted["id"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    bits = code_lengths(counts)
    used = np.flatnonzero(bits)
    spark.createDataFrame(list(zip(used.tolist(), bits[used].tolist(), strict=True)), "id int, bits int").coalesce(1).write.parquet(f"{path}/book")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part, before = canonical_codes(bits), TaskContext.get().partitionId(), 0
        unit = np.dtype(width).itemsize
        ids: list[bytes] = []
        names: list = []
        held, ahead = 0, 0

        def block(behind: int) -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(ids), dtype=width)
            stream, starts = encode_block(flat, bits, codes)
            row = [part, before, len(flat), names, [len(x) // unit for x in ids], ahead, behind, stream, starts.tolist()]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["part", "before", "n_tokens", "docs", "lengths", "earlier", "later", "stream", "checkpoints"])

        for b in batches:
            for doc, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, done = len(value) // unit, 0
                while done < n:
                    take = min(n - done, BLOCK - held)
                    names.append(doc)
                    ids.append(value[done * unit : (done + take) * unit])
                    held, done = held + take, done + take
                    if held == BLOCK:
                        yield block(n - done)
                        before += held
                        ids, names, held = [], [], 0
                        ahead = done if done < n else 0
        if ids:
            yield block(0)

    arrow_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(blocks, "part int, before long, n_tokens long, docs array<long>, lengths array<long>, earlier long, later long, stream binary, checkpoints array<long>").write.option("compression", "none").parquet(f"{path}/blocks")
    return path


def read_token_file(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids, with with_ids), decoded block by block.

    Documents that lie in one block are done there; the pieces of others are put together behind.
    """
    book = spark.read.parquet(f"{path}/book").toPandas()  # bounded by the vocabulary
    bits = np.zeros(int(book["id"].max()) + 1 if len(book) else 1, dtype=np.uint8)
    bits[book["id"].to_numpy(dtype=np.int64)] = book["bits"].to_numpy(dtype=np.uint8)
    placed = with_global_start(spark.read.parquet(f"{path}/blocks"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "piece", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = None
        for b in batches:
            tables = tables or decode_tables(bits, canonical_codes(bits))
            for first, n, docs, lengths, ahead, behind, stream, starts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = decode_block(stream, np.array(starts), n, tables).astype("<u4")
                ends = np.cumsum(lengths)
                cuts = [ids[e - k : e].tobytes() for e, k in zip(ends.tolist(), lengths, strict=True)]
                begins = first + ends - np.array(lengths)
                piece: list = [None] * len(docs)
                if behind:
                    piece[-1] = 0
                if ahead:
                    piece[0] = ahead
                    begins[0] -= ahead
                raw = [c if with_ids or p is not None else None for c, p in zip(cuts, piece, strict=True)]
                columns = [pa.array(docs, pa.int64()), pa.array(begins), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(c) for c in cuts], pa.int64()), pa.array(piece, pa.int64()), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)

    arrow_batches(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, piece long, ids binary"
    decoded = written(placed.select("first", "n_tokens", "docs", "lengths", "earlier", "later", "stream", "checkpoints").mapInArrow(run, schema), "token-decoded")
    # One row of the result is one document, so its pieces meet.
    parts = decoded.where("piece is not null").groupBy("doc_id", "start").agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("pieces"))
    parts = parts.withColumn("ids", F.aggregate("pieces", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"])))
    whole = decoded.where("piece is null").select("doc_id", "start", "n_tokens", "ids_crc32", "ids")
    out = whole.unionByName(parts.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "ids"))
    return out if with_ids else out.drop("ids")
