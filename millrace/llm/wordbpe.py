"""Token ids of whole texts by the tokenizers library, with repeated words encoded once a worker."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm.tables import arrow_batches, texts


class TwoGenerations(dict):
    """A dict that computes missing values and forgets the older half when it has grown by a generation; at most two are held."""

    def __init__(self, compute, generation: int):
        super().__init__()
        self.compute, self.generation, self.older = compute, generation, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.generation:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


#: Classes of Latin-1 bytes, to see punctuation that runs into a mark which would be split off: letters and digits a, white space as a space, marks a full stop, the rest !.
_CLASSES = bytes(ord("a" if c.isalpha() or c in "0123456789" else " " if c in " \n" else "." if c in ".," else "!") for c in map(chr, range(256)))
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds:
    """encode(text) -> little-endian ids, as the library's encode(text, add_special_tokens=False) gives them.

    Where the file's normaliser and splitter treat words between white space one by one, words are looked up in
    a bounded cache and only new ones go through the library; other files are encoded text by text.
    """

    def __init__(self, path: str, generation: int = 150_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.width = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.width == "<u2" else "I"
        conf = json.loads(self.library.to_str())
        norm = [n["type"] for n in (conf["normalizer"] or {}).get("normalizers", [])]
        split = [p.get("pattern", {}).get("Regex") if p["type"] == "Split" else p["type"] for p in (conf["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_word = norm == ["NFC", "Replace", "Lowercase"] and split == [_SPLIT, "ByteLevel"] and conf["model"].get("end_of_word_suffix") is not None and conf["post_processor"] is None
        self.special = [t["content"] for t in conf["added_tokens"]]
        # Byte-level files name each byte by a printable character.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.byte_names = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.words = TwoGenerations(self._word, generation)
        self.raw = TwoGenerations(self._whole, generation // 10)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isalpha():
            return self._whole(word) if word else b""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.byte_names)
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        low = text.lower()
        try:
            classes = low.encode("latin-1").translate(_CLASSES)
        except UnicodeEncodeError:
            # Elsewhere lower-casing or composition may look beyond one character: leave both to the library.
            return b"".join(map(self.raw.__getitem__, text.replace("\n", " ").split(" ")))
        if any(s in low for s in self.special):
            return self._whole(text)
        if b"!. " not in classes and b".. " not in classes:
            low = low.replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")
        return b"".join(map(self.words.__getitem__, low.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_table(docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, before, doc_id, n_tokens, ids: each text's ids as little-endian integers, end_id appended.

    before counts the ids of the same task's earlier rows, so part and before place every row once the table
    is written. A null text counts as empty.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, total = word_ids(path), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.array([end_id], dtype=coder.width).tobytes()
        unit = np.dtype(coder.width).itemsize
        for b in batches:
            ids = [coder.encode(t) + end for t in b.column(1).to_pylist()]
            n = np.array([len(x) // unit for x in ids], dtype=np.int64)
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(before), b.column(0), pa.array(n), pa.array(ids, pa.binary())], ["part", "before", "doc_id", "n_tokens", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "part int, before long, doc_id long, n_tokens long, ids binary")


def id_width(path: str) -> str:
    return word_ids(path).width
