"""Byte-level BPE by backtracking: longest matches, shortened only where neighbours would have merged differently."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.tables import arrow_batches, texts
from millrace.llm.wordbpe import TwoGenerations

#: White space as Unicode's White_Space property has it.
_SPACE = "\t-\r \x85\xa0  -     　"


class ByteBpe:
    """ids(piece bytes) as merging by rank gives them, in time linear in the piece.

    Bytes are handled as Latin-1 text, which is what the automaton takes. Of the tokens that start at a place
    the longest is tried first; a shorter prefix or an earlier choice follows when the token can't stand behind
    the last one. Two tokens can stand side by side if merging their joined bytes gives back just these two;
    that is found from how each was made, and remembered by pair. Tokens that merging never makes are no
    candidates, but a whole piece that is a token is that token.
    """

    def __init__(self, path: str, pattern: str, generation: int = 400_000):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f.read().splitlines() if line]
        self.rank = {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.size = np.zeros(max(self.token) + 1, dtype=np.int64)
        for rank, token in self.token.items():
            self.size[rank] = len(token)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer("".join(self.token[r] for r in sorted(self.token)).encode("latin-1"), dtype=np.uint8)
        # In a set, \s and \S become their members; alone, sets of them.
        spelled = pattern.replace("[^\\s", f"[^{_SPACE}").replace("\\S", f"[^{_SPACE}]").replace("\\s", f"[{_SPACE}]")
        self.pieces = regex.compile(spelled).findall
        #: Texts in which single spaces stand between other characters can be cut there if the pattern only looks at the space before a run.
        self.by_space = " ?\\p{L}+" in pattern
        self.ragged = regex.compile(f"[{_SPACE}] | [{_SPACE}]|^ | $").search
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.beside: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self._learn()
        self.known = TwoGenerations(self._chunk, generation)

    def _learn(self) -> None:
        """How merging makes each token, in rank order, so that every smaller token is known first."""
        self.words, self.made = ahocorasick.Automaton(), {}
        for rank in sorted(self.token):
            token = self.token[rank]
            if len(token) == 1:
                self.parts[rank] = (rank, rank)
            else:
                for cut in range(len(token) - 1, 0, -1):
                    left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                    if left in self.parts and right in self.parts and left < rank and right < rank and self._fits(left, right):
                        self.parts[rank] = (left, right)
                        self.pair[left, right] = rank
                        break
        self.beside.clear()
        for rank in self.parts:
            self.words.add_word(self.token[rank], rank)
            self.made[self.token[rank]] = rank
        self.words.make_automaton()
        self.most = max(map(len, self.rank))
        for rank in self.parts:
            token = self.token[rank]
            self.shorter[rank] = next((r for k in range(len(token) - 1, 0, -1) if (r := self.rank.get(token[:k])) in self.parts), -1)

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging would leave these two side by side: no merge across the border comes before those that made them."""
        bound, pair, parts = 1 << 60, self.pair, self.parts
        while True:
            if pair.get((left, right), 1 << 60) < bound:
                return False
            if left > right:
                bound = left
                left = parts[left][1]
                if left == bound:
                    bound = right + 1
                    right = parts[right][0]
                    if right + 1 == bound:
                        return True
            else:
                bound = right + 1
                right = parts[right][0]
                if right + 1 == bound:
                    bound = left
                    left = parts[left][1]
                    if left == bound:
                        return True

    def _longest(self, piece: str, at: int) -> int:
        """The longest token that starts here: the automaton says how far any token's letters go, and shorter ones follow from there."""
        ahead = piece[at : at + self.most]
        k, made = self.words.longest_prefix(ahead), self.made
        while (found := made.get(ahead[:k])) is None:
            k -= 1
        return found

    def ids(self, piece: str) -> list[int]:
        """piece: bytes as Latin-1 text."""
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        n = len(piece)
        beside, fits, shorter, text, longest = self.beside, self._fits, self.shorter, self.token, self._longest
        if len(beside) > 2_000_000:
            beside.clear()
        out: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest(piece, 0)
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + len(text[token])
                if end not in dead:
                    if last < 0:
                        ok = True
                    elif (ok := beside.get((last, token))) is None:
                        ok = beside[last, token] = fits(last, token)
                    if ok:
                        out.append(token)
                        at = end
                        token = longest(piece, at) if at < n else -1
                        break
                token = shorter[token]
                if token < 0:
                    dead.add(at)
                    token = out.pop()
                    at -= len(text[token])
                    token = shorter[token]
                    while token < 0:
                        dead.add(at)
                        token = out.pop()
                        at -= len(text[token])
                        token = shorter[token]
                    last = out[-1] if out else -1
        return out

    def _piece(self, piece: str) -> tuple[str, bytes]:
        ids = self.ids(piece.encode().decode("latin-1"))
        return ",".join(map(str, ids)), array("i", ids).tobytes()

    def _chunk(self, chunk: str) -> tuple[str, bytes]:
        """A piece, or several; letters behind a space, or none, are always one."""
        if (chunk[1:] if chunk[:1] == " " else chunk).isalpha() and self.by_space:
            return self._piece(chunk)
        pieces = self.pieces(chunk)
        return self._piece(chunk) if len(pieces) == 1 else _joined([self.known[p] for p in pieces])

    def encode(self, text: str) -> tuple[str, bytes]:
        """The ids in decimal, joined by commas, and as 32-bit integers."""
        if not text:
            return "", b""
        if not self.by_space or self.ragged(text):
            return _joined(list(map(self.known.__getitem__, self.pieces(text))))
        first, *rest = text.split(" ")
        known = self.known.__getitem__
        # A chunk keeps the space before it.
        return _joined([known(first), *[known(" " + c) for c in rest]])

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.start[ids] - ends + size, size)].tobytes()


def _joined(found: list[tuple[str, bytes]]) -> tuple[str, bytes]:
    return ",".join([f[0] for f in found]), b"".join([f[1] for f in found])


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of ints) of every whole text, each match of pattern merged by itself, no special tokens.

    A null or empty text has no ids. Repeated rows give repeated results, an empty table none; a text of one
    long match takes time in proportion to its length.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(ranks, pattern)
        for b in batches:
            ids = [np.frombuffer(coder.encode(t)[1], dtype=np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, text of encoded(doc_id, ids); bytes that are no UTF-8 become replacement characters, a null list an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(ranks, pattern)
        for b in batches:
            out = [coder.decode(np.array(x or [], dtype=np.int32)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of encode_documents' ids and of the bytes they decode to, in one pass; nulls as there."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(ranks, pattern)
        for b in batches:
            ids = [coder.encode(t) for t in b.column(1).to_pylist()]
            n = [len(x) // 4 for _, x in ids]
            own = [hashlib.sha256(x.encode()).hexdigest() for x, _ in ids]
            back = [hashlib.sha256(coder.decode(np.frombuffer(x, dtype=np.int32))).hexdigest() for _, x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(own), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
