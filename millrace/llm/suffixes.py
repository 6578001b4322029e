"""Repeated passages by a sparse suffix array: only suffixes that begin at content-chosen anchors are dealt out, sorted and compared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import BITMAP_BITS, arrow_batches, bitmaps, is_small, small, texts, with_hit, written

#: Positions of a text hashed at a time; suffixes in a bucket, on average; suffixes of a bucket hashed at a time.
SEGMENT, BUCKET, SLICE = 1 << 16, 8192, 2048


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out, k = np.ones(n, dtype=np.uint64), 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


class Hasher:
    """Polynomial hashes, mod 2^64, of all pieces of a length: equal pieces have equal hashes wherever they stand."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, longest: int):
        self.up, self.down = _powers(self.BASE, longest + 1), _powers(pow(self.BASE, -1, 1 << 64), longest + 1)
        self.byte = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(self.BASE))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums along the last axis, a column more than data."""
        out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), dtype=np.uint64)
        np.cumsum(self.byte[data] * self.up[: data.shape[-1]], axis=-1, out=out[..., 1:])
        return out

    def pieces(self, sums: np.ndarray, length: int) -> np.ndarray:
        found = (sums[..., length:] - sums[..., :-length]) * self.down[: sums.shape[-1] - length]
        return _mixed(found)


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over every run of width items, from runs of doubled lengths; never x itself."""
    n, k, out = len(x) - width + 1, 1, x
    while 2 * k <= width:
        out = best(out[:-k], out[k:])
        k *= 2
    return best(out[:n], out[width - k : width - k + n])


def anchors(data: bytes, span: int, gram: int, hasher: Hasher, borders: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Places in data, and their hashes, at which a gram has the least hash of all grams of some span-byte piece.

    A piece's least grams depend on the piece alone, so equal pieces have anchors at the same offsets. Long data is
    gone through in stretches that the hasher's powers last for. Where data is several texts joined, none shorter than
    span, borders are the places at which the second and later ones begin: no piece goes over them.
    """
    n, width, segment = len(data), span - gram + 1, len(hasher.up) - span
    over = (np.array(borders, dtype=np.int64)[:, None] + np.arange(1 - span, 0)).ravel()
    places, keys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for first in range(0, n - span + 1, segment):
        own = np.frombuffer(data, dtype=np.uint8, count=min(n - first, segment + span - 1), offset=first)
        hashes = hasher.pieces(hasher.sums(own), gram)
        least = _sliding(hashes, width, np.minimum)
        least[over[(over >= first) & (over < first + len(least))] - first] = 0
        around = np.r_[np.zeros(width - 1, dtype=np.uint64), least, np.zeros(width - 1, dtype=np.uint64)]
        at = np.flatnonzero(hashes == _sliding(around, width, np.maximum))
        places.append(at + first)
        keys.append(hashes[at])
    place, once = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(keys)[once]


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows of 64-bit words by multikey quicksort: three-way splits by one word, the middle part going on to the next word in which it differs."""
    order, todo = np.arange(len(words)), [(0, len(words), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2:
            continue
        own = order[low:high]
        if depth:
            differs = (words[own, depth:] != words[own[0], depth:]).any(axis=0)
            if not differs.any():
                continue
            depth += int(differs.argmax())
        column = words[own, depth]
        pivot = np.partition(column, (high - low) // 2)[(high - low) // 2]
        less, more = column < pivot, column > pivot
        same = ~(less | more)
        order[low:high] = np.concatenate([own[less], own[same], own[more]])
        a, b = low + int(less.sum()), high - int(more.sum())
        todo += [(low, a, depth), (b, high, depth)] + ([(a, b, depth + 1)] if depth + 1 < words.shape[1] else [])
    return order


class Bucket:
    """Suffixes of one range of leading bytes, sorted, with what stands left of each: which of their span-byte pieces stand twice."""

    def __init__(self, leads: list[bytes], lefts: list[bytes], span: int, gram: int, hasher: Hasher):
        self.span, self.reach, self.hasher = span, span - gram, hasher
        width = -(-gram // 8) * 8
        head = b"".join(x[:gram].ljust(width, b"\0") for x in leads)
        words = np.frombuffer(head, dtype=">u8").reshape(len(leads), -1).astype(np.uint64)
        self.order = multikey_order(words)
        self.words = words[self.order]
        self.rows = [lefts[k].rjust(self.reach, b"\0") + leads[k].ljust(span, b"\0") for k in self.order]
        self.left, self.lead = np.array([len(lefts[k]) for k in self.order]), np.array([len(leads[k]) for k in self.order])
        back = np.arange(self.reach + 1)
        #: For each row and each number of bytes to the left, whether the piece from there lies within the text.
        self.valid = (back <= self.left[:, None]) & (span - back <= self.lead[:, None])

    def edges(self) -> np.ndarray:
        """Rows that share the first or last row's gram: others of their kind may be in the buckets beside."""
        first, last = (self.words == self.words[0]).all(axis=1), (self.words == self.words[-1]).all(axis=1)
        return np.flatnonzero(first | last)

    def piece(self, row: int, back: int) -> bytes:
        return self.rows[row][self.reach - back : self.reach - back + self.span]

    def partners(self) -> np.ndarray:
        """For each row and each number of bytes to the left, a row with the same piece (the first such; for that, the second), or -1."""
        m, width = len(self.rows), self.reach + 1
        pieces = np.empty((m, width), dtype=np.uint64)
        for k in range(0, m, SLICE):
            data = np.frombuffer(b"".join(self.rows[k : k + SLICE]), dtype=np.uint8).reshape(-1, self.reach + self.span)
            pieces[k : k + SLICE] = self.hasher.pieces(self.hasher.sums(data), self.span)[:, ::-1]
        out = np.full((m, width), -1, dtype=np.int32)
        for back in range(width):
            rows = np.flatnonzero(self.valid[:, back])
            order = rows[np.argsort(pieces[rows, back], kind="stable")]
            ordered = pieces[order, back]
            same = ordered[1:] == ordered[:-1]
            if not same.any():
                continue
            first = np.r_[True, ~same]
            leader = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            out[order[~first], back] = leader[~first]
            second = np.flatnonzero(first[:-1] & same)
            out[order[second], back] = order[second + 1]
        return out

    def repeated(self, partners: np.ndarray) -> list[tuple[int, int, int]]:
        """row, least and most bytes to the left of pieces that another row has too, compared byte by byte; pieces whose hashes alone agree are sought among all rows."""
        changed = np.ones_like(partners, dtype=bool)
        changed[:, 1:] = partners[:, 1:] != partners[:, :-1]
        row, low = np.nonzero(changed)
        high = np.r_[np.where(row[1:] == row[:-1], low[1:] - 1, self.reach), self.reach] if len(row) else low
        other = partners[row, low]
        found = []
        for r, a, b, o in zip(row.tolist(), low.tolist(), high.tolist(), other.tolist(), strict=True):
            if o < 0:
                continue
            if self.rows[r][self.reach - b : self.reach - a + self.span] == self.rows[o][self.reach - b : self.reach - a + self.span]:
                found.append((r, a, b))
                continue
            for back in range(a, b + 1):
                own = self.piece(r, back)
                if any(k != r and self.valid[k, back] and self.piece(k, back) == own for k in range(len(self.rows))):
                    found.append((r, back, back))
        return found


def _attached(base: DataFrame, found: DataFrame, row_bytes: int) -> DataFrame:
    """base with the columns of the written table found for its tid, or null; only texts that found's bitmap may know are shuffled if found is large."""
    if is_small(found, row_bytes):
        return base.join(F.broadcast(found), "tid", "left")
    tried = with_hit(base, written(bitmaps(found, "tid"), "suffix-texts"), "hit", F.col("tid"))
    return tried.where("hit").drop("hit").join(found, "tid", "left").unionByName(tried.where("not hit").drop("hit"), allowMissingColumns=True)


def _known(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The written table df's rows whose key may be in the written table keys: by its bitmap while that is sparse, else by a join."""
    if keys.count() > BITMAP_BITS // 8:
        return written(df.join(keys, "key", "left_semi"), "suffix-known")
    return with_hit(df, written(bitmaps(keys, "key"), "suffix-bits"), "hit", F.col("key")).where("hit").drop("hit")


def _joined(docs: list, data: list[bytes]) -> Iterator[tuple[list, list[bytes]]]:
    """Texts and their ids in groups of SEGMENT bytes at most, a longer text alone: a group costs little more than one text by itself."""
    first, size = 0, 0
    for k, d in enumerate(data):
        if k > first and size + len(d) > SEGMENT:
            yield docs[first:k], data[first:k]
            first, size = k, 0
        size += len(d)
    if data:
        yield docs[first:], data[first:]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def merged_spans(lists: pa.ListArray) -> pa.ListArray:
    """Of each row's lists of structs of begin and end, the stretches they cover: ascending, apart."""
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    inner = lists.flatten()
    row = pc.take(pc.list_parent_indices(lists), pc.list_parent_indices(inner)).to_numpy(zero_copy_only=False)
    begin, end = (inner.flatten().field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    if not len(row):
        return pa.array([[]] * len(lists), kind)
    order = np.lexsort((begin, row))
    # Rows one after another on one line, so that one running maximum tells where a stretch ends.
    line = row[order] * (int(end.max()) + 1)
    far = np.maximum.accumulate(end[order] + line)
    first = np.flatnonzero(np.r_[True, begin[order][1:] + line[1:] > far[:-1]])
    last = np.r_[first[1:], len(order)] - 1
    counts = np.bincount(row[order][first], minlength=len(lists))
    spans = pa.StructArray.from_arrays([pa.array(begin[order][first]), pa.array((far - line)[last])], fields=list(kind.value_type))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), spans, type=kind)


def _suffixes(base: DataFrame, span: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The suffixes at anchors whose gram stands more than once, as (tid, doc_id, place, low, high, key, context), and the contexts, each once, with n, how often they stand.

    A context is what pieces around an anchor can reach. low and high bound the bytes left of the anchor at which a
    piece can begin within the text. tid is a text's digest.
    """
    reach = span - gram

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, persons = Hasher(SEGMENT + span), [b"%d" % h for h in range(reach + 1)]
        for b in batches:
            for docs, data in _joined(b.column(0).to_pylist(), b.column(1).to_pylist()):
                size, whole = np.array([len(d) for d in data]), b"".join(data)
                end = np.cumsum(size)
                at, key = anchors(whole, span, gram, hasher, end[:-1])
                of = np.searchsorted(end, at, side="right")
                place, stop = at - (end - size)[of], np.minimum(at + span, end[of])
                high = np.minimum(reach, place)
                about = [pa.array([hashlib.sha256(d).digest()[:16] for d in data], pa.binary()), pa.array(docs, pa.int64()), pa.array(size.astype(np.int32))]
                for k in range(0, len(at), SEGMENT):
                    cut = slice(k, k + SEGMENT)
                    own = b"".join(hashlib.blake2b(whole[p - h : z], digest_size=8, person=persons[h]).digest() for p, h, z in zip(at[cut].tolist(), high[cut].tolist(), stop[cut].tolist(), strict=True))
                    row = pa.array(of[cut])
                    numbers = [_long(key[cut]), pa.array(np.frombuffer(own, dtype="<i8")), pa.array(place[cut].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*(c.take(row) for c in about), *numbers], ["tid", "doc_id", "n_bytes", "key", "context", "place"])

    long_enough = base.where(F.octet_length("text") >= span).select("doc_id", F.col("text").cast("binary").alias("data"))
    # One pass over the texts: a second one for the contexts would cost more than the table.
    every = written(long_enough.mapInArrow(anchored, "tid binary, doc_id long, n_bytes int, key long, context long, place int"), "suffix-anchors")
    keys = written(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "suffix-keys")
    low, high = F.greatest(F.lit(0), span - (F.col("n_bytes") - F.col("place"))), F.least(F.lit(reach), F.col("place"))
    found = _known(every, keys).select("tid", "doc_id", F.col("place").cast("long").alias("place"), low.alias("low"), high.alias("high"), "key", "context")
    each = written(found.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(F.struct("tid", "doc_id", "place", "low", "high")).alias("at")).select("key", "context", "n", "at.*"), "suffix-contexts")
    return found, each


def _compared(base: DataFrame, each: DataFrame, span: int, gram: int) -> DataFrame:
    """key, context, low, high: stretches of bytes left of the anchor from which pieces begin that other contexts of the key have too."""
    reach = span - gram
    several = written(each.groupBy("key").agg(F.count("*").alias("of")).where("of > 1").select("key"), "suffix-several")
    needed = written(each.join(small(several, 8), "key", "left_semi"), "suffix-needed")
    # Of a text's copies one row, that of its least doc_id, gives the suffixes.
    # Lists of plain numbers, gathered in one order: a third of what structs would take.
    lists = [F.collect_list(c).alias(n) for n, c in (("places", F.col("place").cast("int")), ("keys", F.col("key")), ("contexts", F.col("context")), ("repeats", F.col("n") > 1))]
    of_text = written(needed.groupBy("tid").agg(F.min("doc_id").alias("owner"), *lists), "suffix-wanted")
    rows = needed.count()
    mean = 24 + 80 + 22 * rows // max(1, of_text.count())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t, *wanted in zip(*(b.column(c).to_pylist() for c in ("text", "places", "keys", "contexts", "repeats")), strict=True):
                data = t.encode("utf-8", "replace")
                out += [(data[p : p + span], data[max(0, p - reach) : p][::-1], key, context, again) for p, key, context, again in zip(*wanted, strict=True)]
            for k in range(0, len(out), BUCKET):
                columns = zip(*out[k : k + BUCKET], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()], strict=True)], ["lead", "back", "key", "context", "repeated"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        lead, back, key, context, repeated = (sum((b.column(k).to_pylist() for b in held), []) for k in range(5))
        bucket = Bucket(lead, [x[::-1] for x in back], span, gram, Hasher(SEGMENT + span))
        partners = bucket.partners()
        order = bucket.order.tolist()
        rows = [(key[order[r]], context[order[r]], a, b, None) for r, a, b in bucket.repeated(partners) if not repeated[order[r]]]
        # A piece at the bucket's edge is told to the others once, with its anchor's place in it: it can have several anchors, and each makes it another piece.
        for r in bucket.edges().tolist():
            for k in np.flatnonzero(bucket.valid[r] & ((partners[r] < 0) | (partners[r] > r))).tolist():
                rows.append((key[order[r]], context[order[r]], k, k, hashlib.blake2b(bucket.piece(r, k), digest_size=16, person=b"%d" % k).digest()))
        for k in range(0, len(rows), SEGMENT):
            columns = zip(*rows[k : k + SEGMENT], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True)], ["key", "context", "low", "high", "piece"])

    wanted = _attached(base.where(F.octet_length("text") >= span), of_text, mean).where("places is not null and doc_id <=> owner").select("text", "places", "keys", "contexts", "repeats")
    # The same row listed twice would give its suffixes again.
    suffixes = wanted.mapInArrow(cut, "lead binary, back binary, key long, context long, repeated boolean")
    ranges = suffixes.repartitionByRange(max(1, -(-rows // BUCKET)), "lead", "back").dropDuplicates(["lead", "back"])
    return written(ranges.mapInArrow(compare, "key long, context long, low int, high int, piece binary"), "suffix-compared")


def repeated_spans(docs: DataFrame, span: int = 400, gram: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (array of begin, end in bytes of UTF-8, ascending, apart), kept (the bytes that no span covers).

    A byte is in a span if a piece of span bytes covers it that also begins anywhere else, in another document or
    in the same one, overlapping or not. Equal pieces have the same anchor (the gram with the least hash), so it is
    enough to look at anchors: those whose gram stands once are done; what is around the others is compared as a
    whole, and where that stands once too, the suffix at the anchor goes to the bucket of its leading bytes, between
    splitters sampled from all suffixes. Buckets are sorted and compared within; pieces of the grams at a bucket's
    ends are compared with those at other buckets' ends. Texts of periodic bytes have an anchor at every place, and
    so cost more. gram is at most span; a longer one leaves fewer suffixes to sort and more anchors.

    A null text is empty; a text shorter than span has no span; a repeated row is a document of its own, so its
    whole text goes if it is long enough, and likewise exact copies: the operator keeps none of them. A doc_id may
    be null or repeated. Other columns stay out; an empty table gives no rows.
    """
    if not 8 <= gram <= span:
        raise ValueError("gram must be from 8 to span")
    arrow_batches(docs.sparkSession)
    reach = span - gram
    base = texts(docs, id_col, text_col).withColumn("tid", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    found, each = _suffixes(base, span, gram)
    compared = _compared(base, each, span, gram)
    across = compared.where("piece is not null")
    twice = written(across.groupBy("piece").agg(F.count("*").alias("of")).where("of > 1").select("piece"), "suffix-across")
    lists = [each.where("n > 1").select("key", "context", "low", "high"), compared.where("piece is null").drop("piece"), across.join(small(twice, 32), "piece", "left_semi").drop("piece")]
    parts = lists[0].unionByName(lists[1]).unionByName(lists[2])
    # A context has reach + 1 pieces at most.
    covers = written(parts.groupBy("key", "context").agg(F.collect_list(F.struct("low", "high")).alias("parts")), "suffix-covers")
    begins: Column = F.transform("parts", lambda c: F.struct((F.col("place") - c["high"]).alias("begin"), (F.col("place") - c["low"] + span).alias("end")))
    pieces = found.join(small(covers, 64), ["key", "context"]).select("tid", begins.alias("spans"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), merged_spans(b.column(1))], ["tid", "spans"])

    # The stretches of one text meet: as many as it has anchors, at most. Copies of a text give the same ones.
    of_text = pieces.groupBy("tid").agg(F.collect_set("spans").alias("lists")).mapInArrow(merge, "tid binary, spans array<struct<begin: long, end: long>>")
    merged = written(of_text, "suffix-spans")
    mean = 16 + int(merged.agg(F.coalesce(F.avg(F.size("spans")), F.lit(0))).first()[0] * 24 + 32)
    whole = _attached(base, merged, mean)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data, at, parts = t.encode("utf-8", "replace"), 0, []
                for s in spans:
                    parts.append(data[at : s["begin"]])
                    at = s["end"]
                kept.append(b"".join([*parts, data[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode("utf-8", "replace")) for t in b.column(1).to_pylist()], pa.int64()), b.column(2), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    schema = "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary"
    touched = whole.where("spans is not null").select("doc_id", "text", "spans").mapInArrow(cut, schema)
    none = F.array().cast("array<struct<begin: bigint, end: bigint>>")
    clean = whole.where("spans is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("spans"), F.encode("text", "UTF-8").alias("kept"))
    return touched.unionByName(clean)
