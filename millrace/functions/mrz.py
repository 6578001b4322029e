"""Machine-readable-zone codec: check digits, formats, fixed-width fields, validation and single-character repair, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters that recognisers confuse, in the order in which repairs are tried.
CONFUSIONS = {"O": "0", "0": "O", "I": "1", "1": "I", "B": "8", "8": "B", "S": "5", "5": "S", "Z": "2", "2": "Z"}


def text(v: Column) -> Column:
    return F.coalesce(v, F.lit(""))


def chars(v: Column) -> Column:
    return F.filter(F.split(text(v), ""), lambda c: c != "")


def char_value(c: Column, dialect: str) -> Column:
    """A character's value, 0 for no character; outside the alphabet null for the worker, 0 for the service. Fillers come as 0."""
    place = F.position(c, F.lit(ALPHABET))
    return (F.nullif(place, F.lit(0)) if dialect == "worker" else F.greatest(place, F.lit(1))) - 1


def let(value: Column, body) -> Column:
    """body of value, which is computed once however often body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Letters and fillers, and the last digits of what they count; how many characters are summed as one number, a multiple of three.
_LETTERS, _LAST_DIGITS = "<" + ALPHABET[10:], "0" + "".join(str(k % 10) for k in range(10, len(ALPHABET)))
_CHUNK = 15


def _weighed(n: Column) -> Column:
    """The weighted sum of a number of _CHUNK digits, right modulo 10: n div 10^k ends in the digit at place k, so each weight's places are added up before the last digit is taken."""

    def last(rest: int) -> Column:
        return reduce(lambda a, b: a + b, [F.call_function("div", n, F.lit(10**k)) if k else n for k in range(rest, _CHUNK, 3)]) % 10

    return last(2) * 7 + last(1) * 3 + last(0)


def check_digit(v: Column, dialect: str = "worker") -> Column:
    """The weighted sum 7-3-1 modulo 10 as a string. A character outside the alphabet makes it null for the worker and counts 0 for the service.

    Every character becomes its value's last digit, and the digits are summed as numbers of _CHUNK places.
    """
    digits = F.translate(text(v), _LETTERS, _LAST_DIGITS)
    if dialect != "worker":
        digits = F.regexp_replace(digits, "[^0-9]", "0")

    def total(d: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(d, F.lit(f"[0-9]{{1,{_CHUNK}}}"), F.lit(0)), lambda c: F.rpad(c, _CHUNK, "0").cast("long"))
        return (F.aggregate(numbers, F.lit(0).cast("long"), lambda a, n: a + _weighed(n)) % 10).cast("string")

    return let(digits, lambda d: F.when(~d.rlike("[^0-9]"), total(d))) if dialect == "worker" else total(digits)


def digit_ok(v: Column, expected: Column, dialect: str = "worker") -> Column:
    """A filler digit always passes; an empty one passes in the service and fails in the worker."""
    blank = F.lit(dialect != "worker")
    return F.when(text(expected) == "<", True).when(text(expected) == "", blank).otherwise(F.coalesce(check_digit(v, dialect) == expected, F.lit(False)))


def clean_lines(raw: Column, minimum: int = 20) -> Column:
    """Upper-cased lines of the permitted characters alone, those of minimum length and more."""
    return F.filter(F.transform(F.split(text(raw), "\n"), lambda s: F.regexp_replace(F.upper(s), "[^A-Z0-9<]", "")), lambda s: F.length(s) >= minimum)


def is_mrz_line(line: Column, dialect: str = "worker") -> Column:
    """Mostly permitted characters: 20 long and nine tenths for the worker; 30 long and eight tenths, after clean-up of space and case, for the service."""
    length, share = (20, 0.9) if dialect == "worker" else (30, 0.8)
    v = text(line) if dialect == "worker" else F.upper(F.regexp_replace(text(line), r"\s", ""))
    return (F.length(v) >= length) & (F.length(F.regexp_replace(v, "[^A-Z0-9<]", "")) >= F.length(v) * share)


def count_mrz_lines(raw: Column, minimum: int = 20) -> Column:
    """How many lines clean_lines keeps, all of which is_mrz_line holds for the worker: those that begin with minimum permitted characters, whatever stands between. One pass over the text."""
    return F.regexp_count(F.upper(text(raw)), F.lit(f"(?dm)^(?:[^A-Z0-9<\\n]*+[A-Z0-9<]){{{minimum}}}"))


def has_mrz_pattern(raw: Column) -> Column:
    return count_mrz_lines(raw) >= 2


def pad_line(line: Column, n: int, truncate: bool = False) -> Column:
    padded = F.rpad(text(line), n, "<")
    return padded if truncate else F.when(F.length(text(line)) < n, padded).otherwise(text(line))


def line_format(l1: Column, l2: Column, l3: Column, dialect: str = "worker") -> Column:
    """TD3, TD2 or TD1 by line lengths; null if too short. The worker looks for three lines before it looks for TD2."""
    n1, n2, n3 = (F.length(text(c)) for c in (l1, l2, l3))
    td3, td2 = (n1 >= 44) & (n2 >= 44), (n1 >= 36) & (n2 >= 36)
    td1 = (n1 >= 30) & (n2 >= 30) & (n3 >= 30)
    if dialect == "worker":
        return F.when(td3, "TD3").when(td1, "TD1").when(td2, "TD2")
    return F.when(td3, "TD3").when(td2, "TD2").when(td1, "TD1")


def name_parts(names: Column) -> Column:
    """surname, given_names, full_name: cut at the first pair of fillers, other fillers are spaces."""
    parts = F.split(text(names), "<<", 2)

    def words(v: Column) -> Column:
        return F.trim(F.regexp_replace(F.replace(v, F.lit("<"), F.lit(" ")), " +", " "))

    two = let(parts, lambda p: F.struct(words(p[0]).alias("surname"), words(F.coalesce(F.try_element_at(p, F.lit(2)), F.lit(""))).alias("given_names")))
    return let(two, lambda n: F.struct(n["surname"].alias("surname"), n["given_names"].alias("given_names"), F.trim(F.concat(n["surname"], F.lit(" "), n["given_names"])).alias("full_name")))


def mrz_date(v: Column, pivot: int = 68, strict: bool = True) -> Column:
    """yyMMdd to an ISO date, years up to pivot in this century.

    Fillers count as 0. strict: at most two fillers and a real calendar date; otherwise any day up to 31 of any
    month up to 12. Anything else is the empty string.
    """
    raw = text(v)
    s = F.translate(raw, "<", "0")
    yy = F.substring(s, 1, 2).try_cast("int")
    year = F.when(yy <= pivot, yy + 2000).otherwise(yy + 1900)
    iso = F.concat_ws("-", year.cast("string"), F.substring(s, 3, 2), F.substring(s, 5, 2))
    shaped = s.rlike("^[0-9]{6}$")
    if strict:
        fillers = F.length(raw) - F.length(F.replace(raw, F.lit("<"), F.lit("")))
        good = shaped & (fillers <= 2) & F.try_to_date(iso, "yyyy-MM-dd").isNotNull()
    else:
        month, day = F.substring(s, 3, 2).try_cast("int"), F.substring(s, 5, 2).try_cast("int")
        good = shaped & month.between(1, 12) & day.between(1, 31)
    return F.when(good, iso).otherwise("")


@dataclass(frozen=True)
class Layout:
    """Where line 2 keeps each field and its digit, 0-based, and which parts the composite digit covers."""

    length: int
    optional: tuple[int, int, int]
    parts: tuple[tuple[int, int], ...]
    composite_at: int


#: The three formats; number, birth and expiry dates lie alike in all of them.
FIELDS = {"passport_number": (0, 9, 9), "date_of_birth": (13, 6, 19), "expiry_date": (21, 6, 27)}
LAYOUTS = {
    "TD3": Layout(44, (28, 14, 42), ((0, 10), (13, 7), (21, 22)), 43),
    "TD2": Layout(36, (28, 7, 35), ((0, 10), (13, 7), (21, 7)), -1),
    "TD1": Layout(30, (28, 2, -1), ((0, 10), (13, 7), (21, 7)), 29),
}


def at(line: Column, start: int, n: int) -> Column:
    return F.substring(text(line), start + 1, n)


def parse(l1: Column, l2: Column, l3: Column, fmt: Column, pivot: int = 68) -> Column:
    """The record's fields, raw widths of the format at hand; unknown formats give empty fields."""
    known = fmt.isNotNull()
    optional = F.when(fmt == "TD3", at(l2, 28, 14)).when(fmt == "TD2", at(l2, 28, 7)).when(fmt == "TD1", F.concat(at(l2, 28, 2), text(l3))).otherwise("")

    def record(names: Column) -> Column:
        fields = {
            "issuing_country": F.replace(at(l1, 2, 3), F.lit("<"), F.lit("")),
            "surname": names["surname"],
            "given_names": names["given_names"],
            "full_name": names["full_name"],
            "passport_number": F.regexp_replace(at(l2, 0, 9), "<+$", ""),
            "nationality": F.replace(at(l2, 10, 3), F.lit("<"), F.lit("")),
            "date_of_birth": mrz_date(at(l2, 13, 6), pivot),
            "sex": F.when(at(l2, 20, 1).isin("M", "F"), at(l2, 20, 1)).otherwise("UNKNOWN"),
            "expiry_date": mrz_date(at(l2, 21, 6), pivot),
            "optional_data": F.replace(optional, F.lit("<"), F.lit("")),
        }
        return F.struct(*[F.when(known, c).otherwise("").alias(n) for n, c in fields.items()])

    return let(name_parts(F.substr(text(l1), F.lit(6))), record)


def validate(l2: Column, fmt: Column, dialect: str = "worker") -> Column:
    """One boolean for each digit, and the codes of those that fail in the fields' order."""
    checks = {name: digit_ok(at(l2, start, n), at(l2, place, 1), dialect) for name, (start, n, place) in FIELDS.items()}
    checks["optional_data"] = F.when(fmt == "TD3", digit_ok(at(l2, 28, 14), at(l2, 42, 1), dialect)).when(fmt == "TD2", digit_ok(at(l2, 28, 7), at(l2, 35, 1), dialect)).otherwise(True)

    def composite(layout: Layout) -> Column:
        return digit_ok(F.concat(*[at(l2, s, n) for s, n in layout.parts]), at(l2, layout.composite_at, 1), dialect)

    td1 = F.when(at(l2, 29, 1).rlike("[0-9]"), composite(LAYOUTS["TD1"])).otherwise(True)
    checks["composite"] = F.when(fmt == "TD3", composite(LAYOUTS["TD3"])).when(fmt == "TD2", checks["passport_number"]).when(fmt == "TD1", td1).otherwise(False)
    held = F.struct(*[F.when(fmt.isNotNull(), c).otherwise(False).alias(n) for n, c in checks.items()])

    def with_errors(c: Column) -> Column:
        errors = F.array_compact(F.array(*[F.when(~c[n], F.lit(f"{n.upper()}_CHECK_FAILED")) for n in checks]))
        return F.struct(*[c[n].alias(n) for n in checks], errors.alias("errors"))

    return let(held, with_errors)


def repair_field(v: Column, expected: Column, dialect: str = "worker", confusions: dict[str, str] | None = None) -> Column:
    """value, repaired: the field itself if its digit passes, else the first single substitution, left to right, that makes it pass, else the field."""
    table = CONFUSIONS if confusions is None else confusions
    pairs = F.create_map(*[F.lit(x) for p in table.items() for x in p])
    whole = text(v)
    candidates = F.filter(
        F.transform(chars(v), lambda c, i: F.when(F.map_contains_key(pairs, c), F.concat(F.substring(whole, F.lit(1), i), F.try_element_at(pairs, c), F.substring(whole, i + 2, F.length(whole))))),
        lambda c: c.isNotNull() & digit_ok(c, expected, dialect),
    )
    # Candidates are only made where the digit fails.
    found = F.when(~digit_ok(whole, expected, dialect), F.try_element_at(candidates, F.lit(1)))
    return let(found, lambda f: F.struct(F.coalesce(f, whole).alias("value"), f.isNotNull().alias("repaired")))


def repair_line2(l2: Column, dialect: str = "worker") -> Column:
    """line2 with each of its three checked fields repaired, and the names of the fields that were. Fields and digits do not overlap, so each is repaired in the line as it came."""
    line = text(l2)
    read = F.struct(*[repair_field(at(l2, start, n), at(l2, place, 1), dialect).alias(name) for name, (start, n, place) in FIELDS.items()])

    def put_back(r: Column) -> Column:
        parts, done = [], 0
        for name, (start, n, _) in FIELDS.items():
            parts += [F.substring(line, done + 1, start - done), r[name]["value"]]
            done = start + n
        fixed = F.array_compact(F.array(*[F.when(r[name]["repaired"], F.lit(name)) for name in FIELDS]))
        return F.struct(F.concat(*parts, F.substring(line, F.lit(done + 1), F.length(line))).alias("line2"), fixed.alias("repaired"))

    return let(read, put_back)


def all_substitutions(v: Column, confusions: dict[str, str] | None = None) -> Column:
    """Every text that replacing any subset of the confusable characters gives, shortest first, then in binary order: 2^k of them for k such characters."""
    pairs = F.create_map(*[F.lit(x) for p in (CONFUSIONS if confusions is None else confusions).items() for x in p])

    def grow(made: Column, c: Column) -> Column:
        kept = F.transform(made, lambda m: F.concat(m, c))
        swapped = F.transform(made, lambda m: F.concat(m, F.try_element_at(pairs, c)))
        return F.when(F.map_contains_key(pairs, c), F.concat(kept, swapped)).otherwise(kept)

    return F.array_sort(F.array_distinct(F.aggregate(chars(v), F.array(F.lit("")), grow)))


def best_substitution(v: Column, expected: Column, dialect: str = "service", confusions: dict[str, str] | None = None) -> Column:
    """The first of all_substitutions whose digit is expected, else the field itself.

    Found without making them all: from the last character on, the first text for each of the ten remainders.
    """
    pairs = F.create_map(*[F.lit(x) for p in (CONFUSIONS if confusions is None else confusions).items() for x in p])
    letters, n = chars(v), F.length(text(v))
    weights = F.array(*map(F.lit, (7, 3, 1)))

    def before(made: Column, i: Column) -> Column:
        c = F.element_at(letters, i)
        weight = F.element_at(weights, (i - 1) % 3 + 1)

        def with_letter(letter: Column, rest: Column) -> Column:
            return F.concat(letter, F.element_at(made, F.pmod(rest - weight * char_value(F.translate(letter, "<", "0"), dialect), F.lit(10)).cast("int") + 1))

        return F.transform(F.sequence(F.lit(0), F.lit(9)), lambda rest: F.least(with_letter(c, rest), with_letter(F.coalesce(F.try_element_at(pairs, c), c), rest)))

    start = F.array(F.lit(""), *[F.lit(None).cast("string")] * 9)
    made = F.when(n > 0, F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), start, before)).otherwise(start)
    found = F.try_element_at(made, F.coalesce(F.when(expected.rlike("^[0-9]$"), expected.try_cast("int")), F.lit(98)) + 1)
    return F.when(check_digit(v, dialect) == expected, v).otherwise(F.coalesce(found, v))


def blanket_corrections(v: Column, kind: str) -> Column:
    """Substitution without a checksum: letters in dates and O and I in numbers become digits, 0 and 1 in names letters."""
    if kind == "date":
        return F.translate(v, "OIZSB", "01258")
    return F.translate(v, "OI", "01") if kind == "number" else F.translate(v, "01", "OI")


def line_pair_score(l1: Column, l2: Column) -> Column:
    """How much two lines look like a TD3 pair."""

    def length(line: Column) -> Column:
        off = F.abs(F.length(line) - 44)
        return F.when(off == 0, 40.0).when(off <= 2, 20.0).otherwise(F.greatest(F.lit(0.0), 20.0 - off * 5.0))

    def fillers(line: Column) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit("<"), F.lit("")))

    bonuses = [
        (l1.rlike("^P[<CN]"), 20.0),
        ((F.length(l1) >= 3) & F.substring(l1, 3, 1).isin("<", "A", "V"), 5.0),
        (l2.rlike("[0-9]{6}"), 10.0),
        (fillers(l1) >= 5, 5.0),
        (fillers(l2) >= 5, 5.0),
    ]
    return reduce(lambda a, b: a + F.when(b[0], b[1]).otherwise(0.0), bonuses, length(l1) + length(l2))


def longest_filler_run(line: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text(line), F.lit("<+"), F.lit(0)), F.length)), F.lit(0))


def likelihood(line: Column) -> Column:
    """10 more for a run of ten fillers, 5 more for one of five."""
    run = longest_filler_run(line)
    return F.when(run >= 10, 10).when(run >= 5, 5).otherwise(0)
