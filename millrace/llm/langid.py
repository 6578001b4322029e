"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tables import arrow_batches, small, texts, written

BUCKETS_LOG2 = 16
LONGEST = 4


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def subwords(text: str) -> np.ndarray:
    """Buckets of all one- to four-character runs of lower-cased words, each word with a mark at both ends; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.where(_letters()[codes], codes, 0).astype(np.uint32)
    if not codes.any():
        return np.empty(0, dtype=np.int64)
    codes = np.concatenate([np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)])
    codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
    word = codes != 0
    out, value = [], codes.copy()
    inner = np.ones(len(codes), dtype=bool)
    for n in range(1, LONGEST + 1):
        if n > 1:
            value = value[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        count = len(codes) - n + 1
        if n == 1:
            good = word
        elif n == 2:
            good = word[:-1] | word[1:]
        else:
            inner = word[1 : 1 + count] if n == 3 else inner[:count] & word[2 : 2 + count]
            good = inner
        spread = (value[good] + np.uint32(n)) * np.uint32(0x9E3779B1)
        out.append(spread >> np.uint32(32 - BUCKETS_LOG2))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    """languages in order; embeddings (buckets by dimensions) and weights (dimensions by languages); temperature and threshold calibrated on rows kept from training."""

    languages: list[str] = field(default_factory=list)
    embeddings: np.ndarray = field(default_factory=lambda: np.zeros((1 << BUCKETS_LOG2, 1), np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self) -> np.ndarray:
        """By bucket and language: as both layers are linear, the average can be taken behind them."""
        return (self.embeddings @ self.weights).astype(np.float32) / np.float32(self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple[np.ndarray, np.ndarray, str]], dimensions: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent over (buckets, shares, language) rows; every fifth row is kept for calibration."""
    languages = sorted({lang for _, _, lang in samples})
    model = Model(languages)
    if not samples:
        return model
    rng = np.random.default_rng(seed)
    e = (rng.random((1 << BUCKETS_LOG2, dimensions), dtype=np.float32) - np.float32(0.5)) / dimensions
    w = np.zeros((dimensions, len(languages)), dtype=np.float32)
    label = np.array([languages.index(lang) for *_, lang in samples])
    kept = np.arange(len(samples)) % 5 == 4
    train = np.flatnonzero(~kept)
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for k in rng.permutation(train):
            buckets, share, _ = samples[k]
            h = share @ e[buckets]
            p = _softmax(h @ w)
            p[label[k]] -= 1
            lr = np.float32(rate * (1 - step / steps))
            back = w @ p
            w -= lr * np.outer(h, p).astype(np.float32)
            # Shares of one text are small: its gradient is scaled up so that frequent subwords move as far as the weights do.
            e[buckets] -= (lr * 10 * share[:, None] * back[None]).astype(np.float32)
            step += 1
    model.embeddings, model.weights = e, w
    check = np.flatnonzero(kept) if kept.any() else train
    z = np.array([share @ e[buckets] @ w for buckets, share, _ in (samples[k] for k in check)])
    grid = np.exp(np.linspace(np.log(0.5), np.log(20), 60))
    model.temperature = float(min(grid, key=lambda t: -np.log(_softmax(z / t)[np.arange(len(check)), label[check]] + 1e-12).mean()))
    p = _softmax(z / model.temperature)
    right = p.argmax(1) == label[check]
    # The least score from which on 99 in 100 calibration rows are right.
    order = np.argsort(-p.max(1), kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) >= 0.99 * np.arange(1, len(order) + 1))
    model.threshold = float(p.max(1)[order[good[-1]]]) if len(good) else 1.0
    return model


def _training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int) -> DataFrame:
    """doc_id, lang, text: equal shares of sample_rows for all languages, those rows with the least hashes of their ids, one row for each id.

    What is sorted has been cut by a rate from the counts before, so neither a task nor a window holds much
    more than a language's share, and an id that is listed often comes as one row for each task.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    usable = rows.where("doc_id is not null and lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 != 2")
    counts = written(usable.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.03).alias("ids")), "language-counts")
    languages = max(1, counts.count())
    share, spread = max(1, sample_rows // languages), 1 << 30
    place = F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    some = usable.join(small(counts, 64), "lang").where(place < F.lit((1.3 * share + 100) * spread) / F.col("ids"))
    one = some.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row")).select("doc_id", "row.lang", "row.text")
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    return one.withColumn("k", F.row_number().over(order)).where(F.col("k") <= share).orderBy(place, "doc_id").limit(sample_rows).select("doc_id", "lang", "text")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = 4000, sample_bytes: int = 256 << 20) -> Model:
    """Fit a Model on at most sample_rows rows, equal shares for all languages, whose subword tables take at most sample_bytes: documented bounds.

    Rows with a null id or language, or whose crc32(doc_id) mod 4 is 2, are never used; of an id listed several
    times one row is. Up to sample_rows languages each get a row; with more, those of the least hashes do. Should the tables of very long
    texts pass sample_bytes, the rows of the largest hashes are left out. No rows: no languages.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, buckets, shares, langs = [], [], [], []
            for doc, text, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found, n = np.unique(subwords(text), return_counts=True)
                if len(found):
                    ids.append(doc)
                    buckets.append(found.astype("<u2").tobytes())
                    shares.append((n / n.sum()).astype("<f4").tobytes())
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary()), pa.array(langs, pa.string())], ["doc_id", "buckets", "shares", "lang"])

    chosen = _training_rows(docs, id_col, text_col, lang_col, sample_rows).select("doc_id", "text", "lang")
    tables = written(chosen.mapInArrow(run, "doc_id long, buckets binary, shares binary, lang string"), "language-sample")
    # At most sample_rows rows: one window over their sizes cuts what comes to the driver.
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    sizes = tables.select("doc_id", (F.octet_length("buckets") + F.octet_length("shares")).alias("size")).withColumn("total", F.sum("size").over(order))
    held = sizes.where(F.col("total") <= sample_bytes).select("doc_id")
    rows = tables.join(F.broadcast(held), "doc_id").select("buckets", "shares", "lang").toPandas()
    rows = sorted(zip(rows["buckets"], rows["shares"], rows["lang"], strict=True))
    return fit([(np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(s, "<f4"), lang) for b, s, lang in rows])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row, from its whole text alone.

    A null text, one without a letter, and any text if no language was learned, is und with score 0. accepted
    tells whether the score reaches the calibrated threshold; with reject, what doesn't is und too. held_out is
    false for a null doc_id. Repeated rows give repeated results, an empty table none.
    """
    arrow_batches(docs.sparkSession)
    table, languages, threshold = model.scores(), model.languages, model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = [], []
            for text in b.column(1).to_pylist():
                buckets = subwords(text) if languages else ()
                if not len(buckets):
                    names.append("und")
                    scores.append(0.0)
                    continue
                # Counts first: a long text has far more subwords than there are buckets.
                if len(buckets) > 1 << BUCKETS_LOG2:
                    z = np.bincount(buckets, minlength=1 << BUCKETS_LOG2) @ table.astype(np.float64) / len(buckets)
                else:
                    z = table[buckets].mean(axis=0, dtype=np.float64)
                p = _softmax(z)
                best = int(p.argmax())
                sure = float(p[best])
                names.append("und" if reject and sure < threshold else languages[best])
                scores.append(sure)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", (F.col("score") >= threshold).alias("accepted"))
