"""Personal data with offset-preserving deobfuscation: rewriting tapes remember which source characters each output character came from."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import arrow_batches, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, place of the kind in KINDS

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
# A match takes whole runs of digits, so it can only begin where a run does.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outward: the local part is all of the run before it that no earlier match took."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Plainly written identifiers: leftmost, non-overlapping within a kind; what fails its test is dropped without another try."""
    out: list[Span] = [(s, e, 0) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν․‐‑‒–﹒", "ABESIJKMHOPCTYXaesijopcyxdhqwABEZHIKMNOPTYXoav.----.", strict=True))
#: The digits' names in four languages.
DIGIT_NAMES = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "oh": 0,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
#: Last labels that make a spaced-out address credible.
TOP_LABELS = "com|org|net|edu|gov|mil|int|info|biz|io|co|me|app|dev|de|fr|es|uk|it|nl|ch|at|be|eu|us|ca|mx|ar|br|example|test|invalid|local"

_NAME = "|".join(sorted(DIGIT_NAMES, key=len, reverse=True))
_BRACKET_AT = re.compile(r"(?i)[\[({<]\s*(?:at|@|arobase|arroba)\s*[\])}>]")
_BRACKET_DOT = re.compile(r"(?i)[\[({<]\s*(?:dot|\.|point|punkt|punto)\s*[\])}>]")
_SPACED = re.compile(rf"(?i)(?<![\w.%+-])[A-Za-z0-9._%+-]+(?P<at>\s+(?:at|arobase|arroba)\s+|\s*@\s*)[A-Za-z0-9-]+(?:(?:\s+(?:dot|point|punkt|punto)\s+|\s*\.\s*)[A-Za-z0-9-]+)*?(?:\s+(?:dot|point|punkt|punto)\s+|\.)(?:{TOP_LABELS})(?![\w-])")
_AT_WORD = re.compile(r"(?i)\s+(?:at|arobase|arroba)\s+|\s*@\s*")
_DOT_WORD = re.compile(r"(?i)\s+(?:dot|point|punkt|punto)\s+|\s*\.\s*")
_SPELLED_HINT = re.compile(rf"(?i)(?<![^\W\d_])(?:{_NAME})(?:[\s,.-]+(?:(?:{_NAME}|dot|point|punkt|punto)(?![^\W\d_])|[0-9]+)){{3,}}")
#: Latin-1 with its letters small, its digits 0 and the separators of spelled digits as spaces.
_SIMPLE = bytes(32 if chr(k).isspace() or chr(k) in ",.-" else 48 if chr(k) in "0123456789" else ord(chr(k).lower()) for k in range(256))
_MIDDLE = rf"(?:{_NAME}|dot|point|punkt|punto|0+)"
#: Parts that every match of the patterns above has, each begun by few characters: a text without them is not rewritten.
_SPELLED_PART = re.compile(f" {_MIDDLE} +{_MIDDLE} ".encode("latin-1"))
_BRACKET_PART = re.compile(r"(?i)[\[({<]\s*(?:at|@|arobase|arroba|dot|\.|point|punkt|punto)\s*[\])}>]")
_SPACED_PART = re.compile(rf"(?i)(?:\s(?:at|arobase|arroba)\s+|@\s*)[A-Za-z0-9-]+(?:(?:\s+(?:dot|point|punkt|punto)\s+|\s*\.\s*)[A-Za-z0-9-]+)*?(?:\s+(?:dot|point|punkt|punto)\s+|\.)(?:{TOP_LABELS})(?![\w-])")


class Tape:
    """Text with, for each character, the source range that it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace each (start, end, by); all of by stands for all of what it replaces."""
        text, starts, ends, done = [], [], [], 0
        for s, e, by in edits:
            text += [self.text[done:s], by]
            starts += self.starts[done:s] + [self.starts[s]] * len(by)
            ends += self.ends[done:s] + [self.ends[e - 1]] * len(by)
            done = e
        self.text = "".join([*text, self.text[done:]])
        self.starts, self.ends = starts + self.starts[done:], ends + self.ends[done:]

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


def letters(tape: Tape) -> None:
    """Look-alike, full-width and styled characters become the plain ones; invisible ones go."""
    edits = []
    for k, c in enumerate(tape.text):
        if c > "\xff" or c == "\xad":
            plain = LOOKALIKES.get(c)
            if plain is None:
                if unicodedata.category(c) in ("Cf", "Mn"):
                    plain = ""
                else:
                    plain = unicodedata.normalize("NFKC", c)
                    if len(plain) != 1 or not plain.isascii():
                        d = unicodedata.digit(c, None)
                        plain = c if d is None else str(d)
            if plain != c:
                edits.append((k, k + 1, plain))
    tape.rewrite(edits)


def spelled_digits(tape: Tape) -> None:
    """Runs of digit names become digits, their separators a space or a full stop; a plus before them a plus sign."""
    edits = []
    for run in _SPELLED_HINT.finditer(tape.text):
        for m in re.finditer(r"[^\s,.-]+|[\s,.-]+", run[0]):
            s, e, low = run.start() + m.start(), run.start() + m.end(), m[0].lower()
            if low in DIGIT_NAMES:
                edits.append((s, e, str(DIGIT_NAMES[low])))
            elif low in ("dot", "point", "punkt", "punto"):
                edits.append((s, e, "."))
            elif low.strip() == "" or low.strip() in (",", "-"):
                edits.append((s, e, ""))
        if m := re.search(r"(?i)(?<!\w)(?:plus|más|mas)\s+$", tape.text[max(0, run.start() - 12) : run.start()]):
            at = max(0, run.start() - 12)
            edits.append((at + m.start(), at + m.end(), "+"))
    tape.rewrite(sorted(edits))


def disguised_signs(tape: Tape) -> None:
    """Bracketed at and dot become signs, the white space around them with them; spaced-out ones only inside what then is an address with a known last label."""
    text = tape.text
    found = sorted([(m.start(), m.end(), "@") for m in _BRACKET_AT.finditer(text)] + [(m.start(), m.end(), ".") for m in _BRACKET_DOT.finditer(text)])
    edits, done = [], 0
    for s, e, sign in found:
        while s > done and text[s - 1].isspace():
            s -= 1
        while e < len(text) and text[e].isspace():
            e += 1
        edits.append((s, e, sign))
        done = e
    tape.rewrite(edits)
    edits = []
    for m in _SPACED.finditer(tape.text):
        edits.append((m.start("at"), m.end("at"), "@"))
        edits += [(d.start(), d.end(), ".") for d in _DOT_WORD.finditer(tape.text, m.end("at"), m.end())]
    tape.rewrite(edits)


TRANSDUCERS: tuple[Callable[[Tape], None], ...] = (letters, spelled_digits, disguised_signs)


def rewritable(text: str) -> bool:
    """False only if no transducer changes the text: letters leaves Latin-1 without soft hyphens, the others what has no part of their patterns."""
    try:
        plain = text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    if b"\xad" in plain:
        return True
    return bool((_SPELLED_PART.search(plain.translate(_SIMPLE)) and _SPELLED_HINT.search(text)) or _BRACKET_PART.search(text) or (_SPACED_PART.search(text) and _SPACED.search(text)))


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that show only after rewriting, as source spans that overlap no base span of their kind."""
    if not rewritable(text):
        return []
    tape = Tape(text)
    for rewrite in TRANSDUCERS:
        rewrite(tape)
    if tape.text == text:
        return []
    out: list[Span] = []
    # Spans of one kind do not overlap, and rewriting keeps their order: each can only touch the base span before or behind it, or the last added.
    plain = {k: [(a, b) for a, b, kind in base if kind == k] for k in range(len(KINDS))}
    last = [0] * len(KINDS)
    for s, e, kind in base_spans(tape.text):
        start, end = tape.source(s, e)
        at = bisect_left(plain[kind], (start, start))
        touched = any(a < end and start < b for a, b in plain[kind][max(0, at - 1) : at + 1])
        if not touched and start >= last[kind]:
            out.append((start, end, kind))
            last[kind] = end
    return out


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that deobfuscation adds, each by start and kind."""
    base = base_spans(text)
    return base, sorted(hidden_spans(text, base), key=lambda s: (s[0], s[2]))


def mask(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping spans, by its first kind in brackets."""
    out, done = [], 0
    for s, e, kind in sorted(spans, key=lambda s: (s[0], s[2])):
        if s >= done:
            out += [text[done:s], f"[{KINDS[kind].upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], s[2])))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", masked: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added, and with masked the text without them.

    One row per row of docs; offsets count code points, ends exclusive. A null or empty text has no spans, and
    the digest of the empty string. Repeated rows give repeated results, an empty table none. Time grows with
    the text's length, however long its runs of digits or letters.
    """
    arrow_batches(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"] + ["masked"] * masked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                base, added = find(text)
                counts = [sum(k == n for *_, k in base) for n in range(4)]
                rows.append([doc, *counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(base + added), len(added)] + [mask(text, base + added)] * masked)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] + [pa.string()] * masked
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    schema = ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans', 'masked') else 'long'}" for n in names)
    return texts(docs, id_col, text_col).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs, all columns and rows, with every span masked in the text and the length column, if there is one, counted anew. Null texts stay null."""
    arrow_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [None if t is None else mask(t, [s for part in find(t) for s in part]) for t in b.column(place).to_pylist()]
            yield b.set_column(place, b.schema.field(place), pa.array(clean, b.schema.field(place).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out
