"""Fill-in-middle: texts cut at unit borders that are found by binary search in run-length encoded character classes."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import arrow_batches, texts

#: For each unit, the class that its runs are found by, and what a run of it counts: each of its characters, or one. A run of other characters counts one where it ends the text, else none.
UNITS = {"line": (re.compile(r"\n+"), True), "word": (re.compile(r"\S+"), False), "char": (re.compile(r".+", re.DOTALL), True)}
MARKS = ("<P>", "<S>", "<M>")


class Runs:
    """The maximal character-class runs of a text: where each begins, and how many units have ended by its end.

    Units are lines (`[^\\n]*\\n|[^\\n]+`), words (`\\s*\\S+|\\s+`) or chars. A text of a million lines without
    blank ones is two million runs; a text without a line break is one.
    """

    def __init__(self, text: str, unit: str = "line"):
        pattern, self.each = UNITS[unit]
        self.begins: list[int] = []
        self.ended: list[int] = []
        self.inside: list[bool] = []
        self.size, at, units = len(text), 0, 0
        for found in pattern.finditer(text):
            first, end = found.span()
            if first > at:
                self._add(at, units, False)
            units += end - first if self.each else 1
            self._add(first, units, True)
            at = end
        if at < self.size:
            units += 1
            self._add(at, units, False)
        self.units = units

    def _add(self, begin: int, ended: int, inside: bool) -> None:
        self.begins.append(begin)
        self.ended.append(ended)
        self.inside.append(inside)

    def offset(self, units: int) -> int:
        """Code points of the first so many units: the run in which the last of them ends is searched, the place within it computed."""
        if units <= 0:
            return 0
        k = bisect_left(self.ended, units)
        if self.inside[k] and self.each:
            return self.begins[k] + units - (self.ended[k - 1] if k else 0)
        return self.begins[k + 1] if k + 1 < len(self.begins) else self.size


def draws(seed: str, doc_id: int | None) -> tuple[int, ...]:
    """Four 32-bit numbers from SHA-256 of seed:doc_id; a null id is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def transform(text: str, draw: tuple[int, ...], unit: str, rate: int, suffix_first: int, marks: tuple[str, str, str]) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text."""
    runs = Runs(text, unit)
    n = runs.units
    if not text or any(m in text for m in marks) or draw[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((draw[0] % (n + 1), draw[1] % (n + 1)))
    a, b = runs.offset(first), runs.offset(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if draw[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: str = "7", rate: int = 100, suffix_first: int = 50, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    rate and suffix_first are percentages of the documents that are transformed, and of these in spm form. A
    null text counts as empty; empty texts and those that hold a mark stay plain, with null prefix_chars and
    middle_chars, so that restored() always gives the text back. The draw depends on seed and doc_id alone:
    repeated rows give repeated results, rows with a null doc_id share one draw. A very long text takes memory in
    proportion to its runs. Other columns, whatever their names, stay out; an empty table gives no rows.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    joins = any(a.endswith(b[:k]) for a in marks for b in marks for k in range(1, len(b) if a == b else len(b) + 1))
    if len(set(marks)) != 3 or not all(marks) or joins or any(a != b and a in b for a in marks for b in marks):
        raise ValueError("marks must be three texts of which none ends as one begins, so that joined pieces make no further mark")
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [(i, *transform(t, draws(seed, i), unit, rate, suffix_first, marks)) for i, t in zip(ids, b.column(1).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of this form was made of."""
    p, s, m = marks

    def behind(whole: Column, part: Column, mark: str) -> Column:
        return F.substr(whole, F.length(part) + len(mark) + 1)

    def parts(lead: str, between: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(lead) + 1))
        one = F.substring_index(body, between, 1)
        rest = behind(body, one, between)
        two = F.substring_index(rest, m, 1)
        return one, two, behind(rest, two, m)

    prefix, suffix, middle = parts(p, s)
    later, earlier, between = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(earlier, between, later)).otherwise(output)
