"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table-lookup distances, exact cosine rerank."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.components import connected_components
from millrace.llm.tables import arrow_batches, is_small, sampled, small, written

#: Rows of one inverted list that one task compares at a time; a larger list is dealt out in pairs of chunks.
CHUNK = 1024
#: Rows from which a list gets lists of its own; vectors that these are fitted on, and vectors for each.
SPLIT, SPLIT_SAMPLE, PER_LIST = 8192, 8192, 64
#: Vectors that a margin is calibrated on, at least.
TRIALS = 1000
#: Codes in one list that one task holds against a chunk of the list's vectors.
VISITORS = 16384
#: Different vector lengths in one table; each is searched by itself, so more than this is an error.
LENGTHS = 256


def borders(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """How far each vector is over the border of each list: from the plane between the list's centroid and that of its own, nearest, list, which is 0 away."""
    squares = (centroids**2).sum(1)
    near = squares[None] - 2 * x @ centroids.T
    own = near.argmin(1)
    apart = np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * centroids @ centroids.T, 1e-12))
    return (near - near[np.arange(len(x)), own][:, None]) / (2 * apart[own])


@dataclass
class Quantiser:
    """centroids: one for each inverted list; codebooks: for each subspace, codewords of residuals; margin: how far over a list's border a vector visits it."""

    centroids: np.ndarray
    codebooks: np.ndarray
    margin: float

    def lists(self, x: np.ndarray) -> np.ndarray:
        """Bool matrix, vectors by lists: the nearest list, and each whose border is within margin."""
        return borders(x, self.centroids) <= self.margin

    def tables(self, residuals: np.ndarray) -> np.ndarray:
        """Squared distances, vectors by subspaces by codewords."""
        m, _, width = self.codebooks.shape
        parts = residuals.reshape(len(residuals), m, width).transpose(1, 0, 2)
        return ((parts**2).sum(2)[:, :, None] + (self.codebooks**2).sum(2)[:, None, :] - 2 * parts @ self.codebooks.transpose(0, 2, 1)).transpose(1, 0, 2)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        n = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(x[order], np.minimum(np.cumsum(n) - n, len(x) - 1), axis=0)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


def _directions(x: np.ndarray, sample: np.ndarray, centroids: np.ndarray, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ways in which links of x may point, each with how far that way leads: to its nearest other vector, to a vector at random, from a centroid to another at random."""
    distance = (sample**2).sum(1)[None] - 2 * x @ sample.T + (x**2).sum(1)[:, None]
    distance[distance < 1e-10] = np.inf  # itself, and what cannot be told from it
    y = distance.argmin(1)
    apart = np.sqrt(distance[np.arange(len(x)), y])
    yield np.where(np.isfinite(apart)[:, None], sample[y] - x, 0), apart
    away = sample[rng.integers(len(sample), size=len(x))] - x
    yield away, np.linalg.norm(away, axis=1)
    away = centroids[rng.integers(len(centroids), size=len(x))] - centroids[rng.integers(len(centroids), size=len(x))]
    yield away, np.linalg.norm(away, axis=1)


def margin_for(sample: np.ndarray, centroids: np.ndarray, reach: float, recall: float) -> float:
    """The margin at which, of two vectors as far apart as links may be, one visits the home of the other: for all pairs with a recall of 1, else for this share of trial pairs.

    A vector's home is its nearest list. The plane between two homes cuts the way between their vectors, so the
    nearer one is half of reach from it at most: at a margin of half of reach no pair is lost. Most data need
    far less, as only the part of a difference across the plane counts. How large that is depends on the data's
    inner dimension and on where links point, so trial pairs at reach are laid through the sample's vectors
    along three kinds of directions (_directions), and along those to neighbours within twice the reach once
    more by themselves. Each kind is held to the recall, and the largest need is taken. It is calibrated on
    these trials: links that point otherwise may be found less often. Samples too small for trials take half
    of reach.
    """
    most = reach / 2
    if recall < 1 and len(sample) >= TRIALS:
        rng = np.random.default_rng(2)
        trial = sample[:: max(1, len(sample) // 8192)]
        needs: list[list[np.ndarray]] = [[], [], [], []]
        for k in range(0, len(trial), 512):
            for kind, (step, apart) in enumerate(_directions(trial[k : k + 512], sample, centroids, rng)):
                some = np.isfinite(apart) & (apart > 1e-5)
                x, far = trial[k : k + 512][some], apart[some]
                half = step[some] * (most / far)[:, None]
                over = [borders(x - half, centroids), borders(x + half, centroids)]
                home, row = [o.argmin(1) for o in over], np.arange(len(x))
                need = np.minimum(over[0][row, home[1]], over[1][row, home[0]])
                needs[kind].append(need)
                if kind == 0:
                    needs[3].append(need[far <= 2 * reach])
        known = [np.concatenate(n) for n in needs]
        if len(known[0]):
            most = min(most, max(np.quantile(n, recall) for n in known if len(n)))
    return float(most) + 1e-4


def fit(sample: np.ndarray, n: int, threshold: float, recall: float = 0.999, seed: int = 1) -> Quantiser:
    """From unit vectors, a sample of n: a list for about 64 vectors, as far as the sample reaches, and up to 16 subspaces of 256 codewords."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    k = int(max(1, min(n // PER_LIST, len(sample) // 8)))
    centroids = _kmeans(sample, k, 8, rng)
    own = ((centroids**2).sum(1)[None] - 2 * sample @ centroids.T).argmin(1)
    residuals = sample - centroids[own]
    m = next(p for p in (16, 8, 4, 2, 1) if dim % p == 0)
    words = min(256, len(sample))
    books = np.stack([_kmeans(np.ascontiguousarray(part), words, 6, rng) for part in residuals.reshape(len(sample), m, dim // m).transpose(1, 0, 2)])
    return Quantiser(centroids, books, margin_for(sample, centroids, float(np.sqrt(2 - 2 * threshold)), recall))


def _read(raw: list[bytes], width: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype=width).reshape(len(raw), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keyed(vectors: DataFrame, id_col: str, vector_col: str, width: str) -> DataFrame:
    """vec_id, dim, key, vec: dim 0 for vectors that link with nothing."""
    arrow_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, keys, raws = [], [], []
            for v in b.column(1).to_pylist():
                raw = b""
                if v and None not in v:
                    x = np.array(v, dtype=width)
                    if np.isfinite(x).all() and x.any():
                        raw = x.tobytes()
                dims.append(len(v) if raw else 0)
                keys.append(hashlib.sha256(raw).digest()[:16])
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "dim", "key", "vec"])

    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v")).mapInArrow(run, "vec_id long, dim int, key binary, vec binary")


def _coded(classes: DataFrame, quantiser: Quantiser, width: str) -> DataFrame:
    """list, rep, n, vec, code, wrong: each class with its vector in its home, and in each list that it visits as a residual code with that code's error."""
    arrow_batches(classes.sparkSession)
    names = ["list", "rep", "n", "vec", "code", "wrong"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(_read(b.column(2).to_pylist(), width)).astype(np.float32)
            over = borders(x, quantiser.centroids)
            home = over.argmin(1)
            nulls = [pa.nulls(b.num_rows, t) for t in (pa.binary(), pa.float32())]
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), *b.columns, *nulls], names)
            row, place = np.nonzero(over <= quantiser.margin)
            row, place = row[place != home[row]], place[place != home[row]]
            for k in range(0, len(row), 1024):
                at, to = row[k : k + 1024], place[k : k + 1024]
                tables = quantiser.tables(x[at] - quantiser.centroids[to])
                codes = tables.argmin(2)
                wrong = np.sqrt(np.maximum(np.take_along_axis(tables, codes[:, :, None], 2).sum((1, 2)), 0))
                reps, ns = (b.column(c).take(pa.array(at)) for c in (0, 1))
                raw = pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), reps, ns, pa.nulls(len(at), pa.binary()), raw, pa.array(wrong.astype(np.float32))], names)

    return classes.select("rep", "n", "vec").mapInArrow(run, "list int, rep long, n long, vec binary, code binary, wrong float")


def _screen(quantiser: Quantiser, threshold: float, width: str):
    """For sorted rows (list, i, j, rep, vec, code, wrong), vectors at home before visiting codes: list, rep of each visitor that the table distance of some vector there does not rule out."""
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tables = None, []
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                if key != tuple(keys[start]):
                    key, tables = tuple(keys[start]), []
                part = b.slice(start, end - start)
                homes = part.num_rows - part.column(4).null_count
                if homes:
                    x = _unit(_read(part.column(4).slice(0, homes).to_pylist(), width)).astype(np.float32)
                    tables.append(quantiser.tables(x - quantiser.centroids[key[0]]))
                visitors = part.slice(homes)
                if not tables or not visitors.num_rows:
                    continue
                codes = np.frombuffer(b"".join(visitors.column(5).to_pylist()), np.uint8).reshape(visitors.num_rows, -1)
                # A code is off by its own error at most, so no pair in reach is passed over here.
                bound = (reach + visitors.column(6).to_numpy()) ** 2
                near = np.zeros(len(codes), dtype=bool)
                for table in tables:
                    for k in range(0, len(table), 128):
                        far = np.zeros((min(128, len(table) - k), len(codes)), dtype=np.float32)
                        for s in range(codes.shape[1]):
                            far += table[k : k + 128, s][:, codes[:, s]]
                        near |= (far <= bound).any(0)
                if near.any():
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in (visitors.column(0), visitors.column(3))], ["list", "rep"])

    return run


def _filed(classes: DataFrame, quantiser: Quantiser, threshold: float, width: str) -> DataFrame:
    """list, lists, rep, n, vec: each class once at home, and once in each list where it visits and its code passes the table distances; lists are all of these.

    Codes travel, of 16 bytes at most, and vectors only where a code has passed. A list with many vectors or
    visitors is dealt out in chunks of the one by chunks of the other.
    """
    coded = written(_coded(classes, quantiser, width), "vector-codes")
    at_home = F.col("vec").isNotNull()
    sizes = coded.groupBy("list").agg(F.count("vec").alias("homes"), F.count("code").alias("visitors")).where((F.col("homes") > CHUNK) | (F.col("visitors") > VISITORS))
    dealt = coded.join(small(written(sizes, "vector-home-sizes"), 24), "list", "left")
    for name, per, of in (("homes", CHUNK, "i"), ("visitors", VISITORS, "j")):
        dealt = dealt.withColumn(f"{of}s", F.coalesce(F.ceil(F.col(name) / per).cast("int"), F.lit(1))).withColumn(of, F.pmod(F.xxhash64("rep", F.lit(11)), F.greatest(f"{of}s", F.lit(1))).cast("int"))
    # With no vector at home or no visitor there is nothing to compare, and sequence would run backwards.
    dealt = dealt.where("`is` > 0 and js > 0")
    sides = [(at_home, "i", "js", "j"), (~at_home, "j", "is", "i")]
    rows = [dealt.where(side).select("list", own, F.explode(F.sequence(F.lit(0), F.col(f"`{n}`") - 1)).alias(other), "rep", "vec", "code", "wrong") for side, own, n, other in sides]
    met = rows[0].unionByName(rows[1]).select("list", "i", "j", "rep", "vec", "code", "wrong").repartition("list", "i", "j").sortWithinPartitions("list", "i", "j", F.col("vec").isNull())
    passed = written(met.mapInArrow(_screen(quantiser, threshold, width), "list int, rep long").distinct(), "vector-visits")
    visits = passed.groupBy("rep").agg(F.collect_list("list").alias("visits"))
    homes = coded.where(at_home).select("list", "rep", "n", "vec").join(F.broadcast(visits) if is_small(passed, 16) else visits, "rep", "left")
    lists = F.coalesce(F.array_union(F.array("list"), "visits"), F.array("list"))
    return homes.select(lists.alias("lists"), "rep", "n", "vec").select(F.explode("lists").alias("list"), "lists", "rep", "n", "vec")


def _first_shared(sets: list[list[int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows, the first member of a's set that is in b's; each pair shares one."""
    most = max(map(len, sets))
    padded = np.array([x + [-1 - k] * (most - len(x)) for k, x in enumerate(sets)])
    first = np.empty(len(a), dtype=np.int64)
    for c in range(0, len(a), 8192):
        shared = padded[a[c : c + 8192]][:, :, None] == padded[b[c : c + 8192]][:, None, :]
        first[c : c + 8192] = np.take_along_axis(padded[a[c : c + 8192]], shared.any(2).argmax(1)[:, None], 1)[:, 0]
    return first


def _list_links(quantiser: Quantiser, threshold: float, width: str):
    """For sorted rows (list, sub, i, j, own, lists, subs, rep, n, vec): a, b, n by row with links in this pair of chunks: itself, the smallest row it reaches here, the vectors it links with here."""
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-3

    def links(place: int, sub: int, i: int, j: int, rows: list[list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, lists, subs, rep, n = np.array(rows[0]), rows[1], rows[2], np.array(rows[3], dtype=np.int64), np.array(rows[4], dtype=np.int64)
        exact = _unit(_read(rows[5], width))
        residual = exact.astype(np.float32) - quantiser.centroids[place]
        tables = quantiser.tables(residual)
        codes = tables.argmin(2)
        m = np.arange(codes.shape[1])
        wrong = np.sqrt(np.maximum(np.take_along_axis(tables, codes[:, :, None], 2).sum((1, 2)), 0))
        left, right = [], []
        for k in range(0, len(rep), 128):
            far = np.zeros((min(128, len(rep) - k), len(rep)), dtype=np.float32)
            for s in m:
                far += tables[k : k + 128, s][:, codes[:, s]]
            # A code is off by its own error at most, so no pair in reach is passed over here.
            a, b = np.nonzero(np.sqrt(np.maximum(far, 0)) <= reach + wrong[None])
            a += k
            keep = (a < b) & ((own[a] != own[b]) if i != j else True)
            a, b = a[keep], b[keep]
            for c in range(0, len(a), 65536):
                x, y = a[c : c + 65536], b[c : c + 65536]
                hit = np.einsum("ij,ij->i", exact[x], exact[y]) >= threshold
                left.append(x[hit])
                right.append(y[hit])
        none = np.empty(0, dtype=np.int64)
        a, b = np.concatenate([none, *left]), np.concatenate([none, *right])
        if len(a):
            # A pair that shares several lists counts in the first of them.
            first = (_first_shared(lists, a, b) == place) & (_first_shared(subs, a, b) == sub)
            a, b = a[first], b[first]
        count = np.bincount(a, weights=n[b], minlength=len(rep)) + np.bincount(b, weights=n[a], minlength=len(rep))
        label = rep.copy()
        while len(a):
            before = label.copy()
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            if (label == before).all():
                break
        some = count > 0
        return rep[some], label[some], count[some].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, [[] for _ in range(6)]
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for new, *values in zip(zip(*columns[:4], strict=True), *columns[4:], strict=True):
                if new != key:
                    if len(rows[3]) > 1:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(*key, rows)], ["a", "b", "n"])
                    key, rows = new, [[] for _ in range(6)]
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
        if len(rows[3]) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(*key, rows)], ["a", "b", "n"])

    return run


def _fit_list(reach: float, recall: float, width: str):
    """For a sample of one large list (list, size, vec): centroids of its own lists and their margin; no row if these would not save three quarters of the comparisons, as among vectors that are all alike."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = _unit(_read(rows["vec"].tolist(), width)).astype(np.float32)
        k = int(min(rows["size"].iloc[0] // PER_LIST, len(x) // 8))
        centroids = _kmeans(x, k, 8, np.random.default_rng(1)) if k > 1 else x[:1]
        margin = margin_for(x, centroids, reach, recall)
        filed = (borders(x, centroids) <= margin).sum(0).astype(np.float64)
        keep = k > 1 and (filed**2).sum() <= len(x) ** 2 / 4
        return pd.DataFrame({"list": rows["list"].iloc[:1], "margin": [margin], "centroids": [centroids.astype("<f4").tobytes()]})[: int(keep)]

    return run


def _file_again(width: str):
    """For sorted rows, a head with a list's centroids before its vectors: each vector once for each of the list's own lists that it is filed in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["list", "sub", "lists", "subs", "rep", "n", "vec"]
        centroids, margin = None, 0.0
        for b in batches:
            head = b.column(2).to_numpy(zero_copy_only=False) == 0
            cuts = [0, *np.flatnonzero(head).tolist(), b.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start < end and head[start]:
                    centroids, margin = b.column(4)[start].as_py(), b.column(3)[start].as_py()
                    start += 1
                if start == end:
                    continue
                part = b.slice(start, end - start)
                x = _unit(_read(part.column(8).to_pylist(), width)).astype(np.float32)
                row, place = np.nonzero(borders(x, np.frombuffer(centroids, "<f4").reshape(-1, x.shape[1])) <= margin)
                subs = pa.array(np.split(place.astype(np.int32), np.flatnonzero(np.diff(row)) + 1), pa.list_(pa.int32()))
                at = pa.array(row)
                of = [part.column(k).take(at) for k in (0, 5, 6, 7, 8)]
                yield pa.RecordBatch.from_arrays([of[0], pa.array(place.astype(np.int32)), of[1], subs.take(at), *of[2:]], names)

    return run


def _split(filed: DataFrame, reach: float, recall: float, width: str) -> DataFrame:
    """filed with sub and subs: where a list has SPLIT rows or more, it gets lists of its own, so lists stay short as the vectors become more; elsewhere the one sub is 0."""
    one = F.lit(0).cast("int")
    whole = filed.select("list", one.alias("sub"), "lists", F.array(one).alias("subs"), "rep", "n", "vec")
    large = written(filed.groupBy("list").agg(F.count("*").alias("size")).where(F.col("size") >= SPLIT), "vector-split-sizes")
    if large.isEmpty():
        return whole
    spread = 1 << 30
    some = filed.join(small(large, 16), "list").where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(spread)) < F.lit(1.2 * SPLIT_SAMPLE * spread) / F.col("size"))
    heads = written(some.select("list", "size", "vec").groupBy("list").applyInPandas(_fit_list(reach, recall, width), "list int, margin double, centroids binary"), "vector-split-heads")
    parts = written(large.join(small(heads.select("list"), 16), "list").select("list", F.ceil(F.col("size") / 65536).cast("int").alias("parts")), "vector-split-parts")
    first = heads.join(small(parts, 16), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), one.alias("head"), "margin", "centroids", *[F.lit(None).cast(t).alias(c) for c, t in filed.drop("list").dtypes])
    rest = filed.join(small(parts, 16), "list").select("list", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("head"), F.lit(None).cast("double").alias("margin"), F.lit(None).cast("binary").alias("centroids"), "lists", "rep", "n", "vec")
    again = first.unionByName(rest).repartition("list", "part").sortWithinPartitions("list", "part", "head")
    again = again.mapInArrow(_file_again(width), "list int, sub int, lists array<int>, subs array<int>, rep long, n long, vec binary")
    return written(whole.join(small(parts, 16), "list", "left_anti").unionByName(again), "vector-sub-lists")


def _search(classes: DataFrame, threshold: float, width: str, sample_rows: int, recall: float) -> DataFrame:
    """a, b, n over all lists for the written classes(rep, n, vec) of one dimension, written."""
    spark = classes.sparkSession
    arrow_batches(spark)
    sample = sampled(classes, "rep", sample_rows).select("vec").toPandas()["vec"].tolist()
    quantiser = fit(_unit(_read(sample, width)).astype(np.float32), classes.count(), threshold, recall)
    filed = _split(written(_filed(classes, quantiser, threshold, width), "vector-lists"), float(np.sqrt(2 - 2 * threshold)), recall, width)
    sizes = written(filed.groupBy("list", "sub").agg(F.count("*").alias("size")).where(F.col("size") > CHUNK), "vector-large-lists")
    dealt = filed.join(small(sizes, 24), ["list", "sub"], "left").withColumn("chunks", F.coalesce(F.ceil(F.col("size") / CHUNK).cast("int"), F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("chunks")).cast("int"))
    rows = ["lists", "subs", "rep", "n", "vec"]
    dealt = dealt.select("list", "sub", "own", *rows, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("list", "sub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *rows)
    key = ["list", "sub", "i", "j"]
    return written(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_list_links(quantiser, threshold, width), "a long, b long, n long"), "vector-links")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, sample_rows: int = 20_000, recall: float = 0.9999) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors of one dimension link when their cosine, in double precision, is threshold or more. Identical ones
    are searched as one. A vector is at home in its nearest inverted list and visits those whose border is near,
    first as a residual code; where the code's table distance to a vector at home there does not rule a link
    out, the vector itself follows for the exact cosine. Lists and codebooks come from at most sample_rows
    vectors (fewer if they would take over 128 MB), a documented bound, and every vector is filed. A list with
    many vectors gets lists of its own, from a sample of itself. No pair below the threshold is reported. How
    near is near is calibrated on trial pairs at the threshold, closer ones being surer; with recall = 1 no pair
    is lost, at the price of more lists for each vector (see margin_for). A dense crowd that no lists split is
    compared by pairs of chunks: whole, by bounded tasks, with the square of its size. More than LENGTHS
    different vector lengths in one table are an error, as each is searched by itself.
    Null and zero vectors, and those with null or non-finite components, link with nothing, and so do rows
    without a vec_id. Repeated rows count as further vectors; an empty table gives no rows.
    """
    kind = vectors.schema[vector_col].dataType
    width = "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"
    keyed = written(_keyed(vectors, id_col, vector_col, width), "vector-keys")
    valid = keyed.where("dim > 0 and vec_id is not null")
    classes = written(valid.groupBy("dim", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")), "vector-classes")
    found = None
    lengths = classes.select("dim").distinct().orderBy("dim").limit(LENGTHS + 1).collect()
    if len(lengths) > LENGTHS:
        raise ValueError(f"{vector_col} holds vectors of more than {LENGTHS} different lengths")
    for row in lengths:
        rows = max(1, min(sample_rows, (128 << 20) // (8 * row["dim"])))
        own = _search(classes.where(F.col("dim") == row["dim"]), threshold, width, rows, recall)
        found = own if found is None else found.unionByName(own)
    rest = keyed if found is None else keyed.where("dim = 0 or vec_id is null")
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if found is None:
        return alone
    counted = written(found.groupBy("a").agg(F.sum("n").alias("links")), "vector-counts")
    components = written(connected_components(found, "a", "b"), "vector-components")
    of_class = classes.join(small(counted, 24), classes["rep"] == counted["a"], "left").join(small(components, 24), classes["rep"] == components["node"], "left")
    of_class = written(of_class.select("dim", "key", (F.coalesce(F.col("links"), F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce(F.col("component"), F.col("rep")).alias("component_id")), "vector-classes-of")
    linked = valid.select("vec_id", "dim", "key").join(small(of_class, 64), ["dim", "key"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)
