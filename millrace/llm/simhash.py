"""SimHash near-duplicates by pigeonhole blocks: 64-bit fingerprints that differ in few bits share whole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import connected_components
from millrace.llm.tables import arrow_batches, once, small, texts, without, written

SEED = 42
#: Rows of one block key that one task compares at a time; a larger bucket is dealt out in pairs of chunks.
CHUNK = 1024


def fingerprint(text: str, width: int = 4) -> int:
    """A-Z lower-cased, words between ASCII white space, space-joined shingles of width words with repeats; a bit is 1 if set in over half the hashes. No words: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    stops = (ends[width - 1 :] - 1).tolist()
    starts = [0, *ends[: len(words) - width].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[i:j], SEED) for i, j in zip(starts, stops, strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), mark (a 64-bit hash of the text), one row per row of docs; a null text counts as empty, fp 0."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), b.column(2)], ["doc_id", "fp", "mark"])

    return texts(docs, id_col, text_col).withColumn("mark", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, mark long")


def block_layout(n: int, distance: int, per_key: int = 8) -> list[list[tuple[int, int]]]:
    """For each key, the (first bit, bits) blocks that it joins.

    With b blocks, fingerprints within distance bits agree in b - distance of them at least, so one key for each
    choice of that many blocks misses no pair. More blocks make longer keys: b grows with the number of
    fingerprints until random ones meet in keys of per_key rows on average.
    """
    for b in range(distance + 1, 13):
        cuts = [round(64 * k / b) for k in range(b + 1)]
        blocks = [(cuts[k], cuts[k + 1] - cuts[k]) for k in range(b)]
        keys = [list(c) for c in combinations(blocks, b - distance)]
        if n / 2 ** min(sum(w for _, w in c) for c in keys) <= per_key:
            break
    return keys


def _block_keys(layout: list[list[tuple[int, int]]]) -> F.Column:
    def bits(first: int, width: int) -> F.Column:
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))

    out = []
    for number, blocks in enumerate(layout):
        key, at = F.lit(number).cast("long"), 0
        key = F.shiftleft(key, 52)
        for first, width in blocks:
            key = key.bitwiseOR(F.shiftleft(bits(first, width), at))
            at += width
        out.append(key)
    return F.array(*out)


def _forest(fp: np.ndarray, rep: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what fingerprints within distance connect in this bucket: each node with the smallest node that it reaches here."""
    n = len(fp)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
    label = rep.copy()
    while True:
        least = np.empty_like(label)
        for k in range(0, n, 256):
            least[k : k + 256] = np.where(near[k : k + 256], label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (least == label).all():
            break
        label = least
    own = label != rep
    return rep[own], label[own]


def _bucket_links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket (key, i, j); a bucket holds two chunks at most."""
        held: list[np.ndarray] = [np.empty(0, np.int64) for _ in range(4)]

        def links(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            key, pair, fp, rep = cols
            if not len(key):
                return np.empty(0, np.int64), np.empty(0, np.int64)
            new = np.r_[True, (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])]
            run_id = np.cumsum(new)
            size = np.bincount(run_id)[run_id]
            bits, left, right = fp.view(np.uint64), [], []
            # Small buckets all at once: row r against row r + d of the same bucket.
            few = np.flatnonzero((size > 1) & (size <= 24))
            ids, fps, reps = run_id[few], bits[few], rep[few]
            for d in range(1, 24):
                if len(ids) <= d:
                    break
                same = ids[d:] == ids[:-d]
                if not same.any():
                    break
                hit = np.flatnonzero(same & (np.bitwise_count(fps[d:] ^ fps[:-d]) <= distance))
                left.append(reps[hit])
                right.append(reps[hit + d])
            starts = np.flatnonzero(new & (size > 24))
            for s in starts.tolist():
                a, b = _forest(bits[s : s + size[s]], rep[s : s + size[s]], distance)
                left.append(a)
                right.append(b)
            return np.concatenate([np.empty(0, np.int64), *left]), np.concatenate([np.empty(0, np.int64), *right])

        def batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for got in batches:
            cols = [np.concatenate([h, got.column(k).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held)]
            key, pair = cols[0], cols[1]
            last = np.flatnonzero((key != key[-1]) | (pair != pair[-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield batch(*links([c[:cut] for c in cols]))
        yield batch(*links(held))

    return run


def fingerprint_links(classes: DataFrame, distance: int = 4) -> DataFrame:
    """a, b: links between the rows of classes(fp, rep), distinct fingerprints, enough to connect all that differ in distance bits or fewer.

    Buckets of more than CHUNK rows are dealt out by pairs of chunks: every pair of rows still meets in one
    task, no task holds more than two chunks, and each hands on a spanning forest, not its pairs.
    """
    n = classes.count()
    keyed = classes.select("fp", "rep", F.explode(_block_keys(block_layout(n, distance))).alias("key"))
    # The counted keys are few: only buckets of over CHUNK different fingerprints.
    large = written(keyed.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > CHUNK), "simhash-large")
    dealt = keyed.join(small(large, 24), "key", "left").withColumn("chunks", F.coalesce(F.ceil(F.col("c") / CHUNK).cast("int"), F.lit(1)))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    pairs = F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(j, F.col("own")).cast("long") * F.col("chunks") + F.greatest(j, F.col("own")))
    )
    dealt = dealt.withColumn("own", own).select("key", F.explode(pairs).alias("pair"), "fp", "rep")
    arrow_batches(classes.sparkSession)
    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_bucket_links(distance), "a long, b long")


def _classified(docs: DataFrame, id_col: str, text_col: str, width: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """The written fingerprints of all rows, and fp, component_id for each fingerprint that a row with an id has."""
    fps = written(fingerprints(docs, id_col, text_col, width), "simhash-fps")
    classes = written(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    # Fingerprints themselves are linked: a doc_id with several texts joins no two of them.
    found = written(connected_components(fingerprint_links(classes.select("fp", F.col("fp").alias("rep")), distance), "a", "b"), "simhash-components")
    of = written(classes.join(small(found, 16), classes["fp"] == found["node"], "left").select("fp", "least", "component"), "simhash-of")
    first = written(of.where("component is not null").groupBy("component").agg(F.min("least").alias("first")), "simhash-firsts")
    return fps, written(of.join(small(first, 16), "component", "left").select("fp", F.coalesce("first", "least").alias("component_id")), "simhash-classes-of")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Documents link when their fingerprints differ in distance bits or fewer; equal ones differ in none. Null,
    empty and blank texts have fingerprint zero and link like any other. Rows with a null doc_id are in no
    class: their component_id is null. Repeated rows give repeated results, a doc_id with several texts one
    row for each by its own fingerprint; an empty table gives none. Texts with one fingerprint count once in
    the search, so copies of a text cost nothing there.
    """
    fps, component = _classified(docs, id_col, text_col, width, distance)
    out = fps.join(small(component, 16), "fp", "left")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", hexed.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document, the smallest doc_id, of each component.

    A row goes by its id together with its text, so another text under the same id stays if nothing links to it, and
    of a row that is listed several times one stays. Rows without a doc_id stay.
    """
    fps, component = _classified(docs, "doc_id", "text", 4, 4)
    dropped = fps.join(small(component, 16), "fp").where("doc_id != component_id").select("doc_id", "mark").distinct()
    mark = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    twice = fps.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    return once(without(docs, written(dropped, "simhash-dropped"), mark), written(twice, "simhash-listed"), mark)
