"""The repairing zone parser with lineage: each field as it was read, as it is taken, and whether it was corrected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import mrz
from millrace.functions.mrz import let

#: What a number's characters, and a date's, are tried as; one code that is often misread; letters put right in dates whose digit helps no further.
NUMBER_SWAPS = {"O": "0", "0": "O", "I": "1", "1": "I"}
DATE_SWAPS = NUMBER_SWAPS | {"L": "1", "Z": "2", "S": "5", "B": "8", "G": "6"}
COUNTRY_REPAIRS = {"VNB": "VNM"}
DATE_LETTERS = ("SBG", "586")
#: The end of the names in line 1, the optional data's end in line 2 and its digit's place.
ENDS = {"TD3": (44, 42, 42), "TD2": (36, 36, 35), "TD1": (30, 30, None)}
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ<"
_REMAINDERS = "012345678901234567890123450"
FIELDS = ("document_type", "issuing_country", "surname", "given_name", "full_name", "passport_number", "nationality", "date_of_birth", "gender", "expiry_date", "optional_data")


def digit(v: Column, width: int) -> Column:
    """The check digit of up to width characters, those outside the alphabet counting 0: every character's remainder by ten first, then a sum at fixed places."""
    tens = F.regexp_replace(F.translate(mrz.text(v), _LETTERS, _REMAINDERS), "[^0-9]", "0")

    def total(s: Column) -> Column:
        parts = [F.greatest(F.ascii(F.substring(s, k + 1, 1)) - 48, F.lit(0)) * (7, 3, 1)[k % 3] for k in range(width)]
        return (sum(parts[1:], parts[0]) % 10).cast("string")

    return let(tens, total)


def field(value: Column, raw: Column, corrected: Column | bool, valid: Column | bool) -> Column:
    def flag(v: Column | bool) -> Column:
        return F.lit(v) if isinstance(v, bool) else F.coalesce(v, F.lit(False))

    return F.struct(value.alias("value"), raw.alias("raw"), flag(corrected).alias("corrected"), flag(valid).alias("valid"))


def _correction(name: str, before: Column, after: Column, reason: str) -> Column:
    return F.when(before != after, F.struct(F.lit(name).alias("field"), before.alias("from"), after.alias("to"), F.lit(reason).alias("reason")))


def _letters(v: Column) -> Column:
    """Digits that stand for letters in names and codes."""
    return F.translate(v, "01", "OI")


def _date(v: Column, century: int) -> Column:
    return F.when(v.rlike("^[0-9]{6}$"), mrz.mrz_date(v, century, strict=False)).when(v.isNotNull(), "")


def repaired_number(raw: Column, expected: Column, correct: bool = True, check: bool = True) -> Column:
    """to, reason: the number's characters put right, or null.

    With its digit: the first, in binary order, of all subsets of swaps with the digit, those of numbers first,
    then those of dates. Without: the first of all other subsets, if a character can be misread at all.
    """
    if not correct:
        return F.struct(F.lit(None).cast("string").alias("to"), F.lit(None).cast("string").alias("reason"))
    if not check:
        made = F.filter(mrz.all_substitutions(raw, NUMBER_SWAPS), lambda c: c != raw)
        found, reason = F.when(raw.rlike("[O0I1]"), F.try_element_at(made, F.lit(1))), "ocr_fix"
    else:
        fails = ~expected.isin("", "<") & (digit(raw, 9) != expected)

        def first(swaps: dict[str, str], otherwise) -> Column:
            return let(mrz.best_substitution(raw, expected, "service", swaps), lambda c: F.when(c != raw, c).otherwise(otherwise()))

        found, reason = F.when(fails, first(NUMBER_SWAPS, lambda: first(DATE_SWAPS, lambda: F.lit(None).cast("string")))), "checksum_fix"
    return let(found, lambda to: F.struct(to.alias("to"), F.when(to.isNotNull(), reason).alias("reason")))


def repaired_date(raw: Column, expected: Column, century: int, correct: bool = True) -> Column:
    """value (an ISO date or empty), corrected. A date that reads and whose digit holds stays; else the first subset of swaps with the digit that reads, else the letters that stand for digits, else the date as it reads."""
    if not correct:
        return F.struct(_date(raw, century).alias("value"), F.lit(False).alias("corrected"))
    blank = expected.isin("", "<")

    def mended(plain: Column) -> Column:
        """The date by its digit, or by its letters, or null. Each is computed where it is wanted, once."""
        fits = F.filter(mrz.all_substitutions(raw, DATE_SWAPS), lambda c: (c != raw) & (digit(c, 6) == expected) & (_date(c, century) != ""))
        by_digit = F.when(~blank, let(F.try_element_at(fits, F.lit(1)), lambda c: _date(c, century)))
        by_letter = let(F.translate(raw, *DATE_LETTERS), lambda c: F.when((c != raw) & (_date(c, century) != ""), _date(c, century)))
        return F.when((plain == "") | ~(blank | (digit(raw, 6) == expected)), F.coalesce(by_digit, by_letter))

    return let(_date(raw, century), lambda plain: let(mended(plain), lambda v: F.struct(F.coalesce(v, plain).alias("value"), v.isNotNull().alias("corrected"))))


def repaired_records(rows: DataFrame, lines: str, correct: bool = True, check: bool = True, century: int = 49, out: str = "record") -> DataFrame:
    """rows with the struct out: format, the FIELDS each as (value, raw, corrected, valid), corrections (field, from, to, reason), checks, overall_valid.

    lines is an array of text lines; they are trimmed, and empty ones do not count. A field that a repair has
    changed counts as valid in the checks, whose digits are those of the line as it was read. Corrections list
    the codes', names' and number's; a date's shows in its own field. Less than two lines, lines that are too
    short and null lines give format UNKNOWN, empty fields, null checks and overall_valid false.
    """
    from millrace.operators.windows import materialised

    whole = F.filter(F.transform(F.col(lines), lambda s: F.trim(mrz.text(s))), lambda s: s != "")
    l1, l2, l3 = (F.coalesce(F.try_element_at(F.col("_lines"), F.lit(k)), F.lit("")) for k in (1, 2, 3))
    fmt = F.coalesce(mrz.line_format(l1, l2, F.rpad(l3, 30, "<"), "service"), F.lit("UNKNOWN"))
    base = materialised(rows, "_lines", whole).withColumns({"_l1": l1, "_l2": l2, "_l3": l3, "_fmt": fmt})
    one, two, three, kind = (F.col(c) for c in ("_l1", "_l2", "_l3", "_fmt"))

    def cut(line: Column, start: int, end: int) -> Column:
        return F.substring(line, start + 1, end - start)

    def by_format(values: dict[str, Column]) -> Column:
        picked = F.when(kind == "TD3", values["TD3"])
        return picked.when(kind == "TD2", values["TD2"]).when(kind == "TD1", values["TD1"])

    def plain(v: Column) -> Column:
        return F.replace(v, F.lit("<"), F.lit(""))

    number, expected = cut(two, 0, 9), cut(two, 9, 10)
    optional = by_format({"TD3": cut(two, 28, 42), "TD2": cut(two, 28, 36), "TD1": F.trim(F.replace(F.concat(cut(two, 28, 30), three), F.lit("<"), F.lit(" ")))})
    read = F.struct(
        plain(cut(one, 2, 5)).alias("issuing"),
        by_format({f: cut(one, 5, end) for f, (end, _, _) in ENDS.items()}).alias("names"),
        repaired_number(number, expected, correct, check).alias("number"),
        plain(cut(two, 10, 13)).alias("nation"),
        repaired_date(cut(two, 13, 19), cut(two, 19, 20), century, correct).alias("birth"),
        repaired_date(cut(two, 21, 27), cut(two, 27, 28), century, correct).alias("expiry"),
        optional.alias("optional"),
    )
    base = materialised(base, "_r", read)
    known = kind != "UNKNOWN"

    def code(raw: Column) -> tuple[Column, Column]:
        """A code with digits turned into letters, and that with the known misreading put right."""
        if not correct:
            return raw, raw
        lettered = _letters(raw)
        repairs = F.create_map(*[F.lit(x) for p in COUNTRY_REPAIRS.items() for x in p])
        return lettered, F.coalesce(F.try_element_at(repairs, lettered), lettered)

    issuing, nation = F.col("_r.issuing"), F.col("_r.nation")
    (issuing1, issuing2), (nation1, nation2) = code(issuing), code(nation)
    names = _letters(F.col("_r.names"))
    parts = F.split(names, "<<")
    surname = F.trim(F.replace(parts[0], F.lit("<"), F.lit(" ")))
    given = F.trim(F.replace(F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "<"), F.lit("<"), F.lit(" ")))
    name_fixed = names != F.col("_r.names")
    number_fixed = F.col("_r.number.to").isNotNull()
    taken = plain(F.coalesce(F.col("_r.number.to"), number))
    kind_letter, sex = cut(one, 0, 1), cut(two, 20, 21)
    fields = {
        "document_type": field(F.when(kind_letter == "P", "PASSPORT").when(kind_letter == "I", "ID_CARD").otherwise(kind_letter), kind_letter, False, True),
        "issuing_country": field(issuing2, issuing2, issuing2 != issuing, F.length(issuing2) == 3),
        "surname": field(surname, names, name_fixed, surname != ""),
        "given_name": field(given, names, name_fixed, given != ""),
        "full_name": field(F.concat_ws(" ", F.nullif(surname, F.lit("")), F.nullif(given, F.lit(""))), names, name_fixed, (surname != "") | (given != "")),
        "passport_number": field(taken, plain(number), number_fixed, taken != ""),
        "nationality": field(nation2, nation2, nation2 != nation, F.length(nation2) == 3),
        "date_of_birth": field(F.col("_r.birth.value"), cut(two, 13, 19), F.col("_r.birth.corrected"), F.col("_r.birth.value") != ""),
        "gender": field(F.when(sex.isin("M", "F"), sex).otherwise("UNKNOWN"), sex, False, sex.isin("M", "F")),
        "expiry_date": field(F.col("_r.expiry.value"), cut(two, 21, 27), F.col("_r.expiry.corrected"), F.col("_r.expiry.value") != ""),
        "optional_data": field(F.when(kind == "TD1", F.col("_r.optional")).otherwise(F.trim(plain(F.col("_r.optional")))), F.col("_r.optional"), False, True),
    }
    empty = field(F.lit(""), F.lit(""), False, False)
    corrections = F.array_compact(
        F.array(
            _correction("issuing_country", issuing, issuing1, "ocr_fix"),
            _correction("issuing_country", issuing1, issuing2, "ocr_fix"),
            _correction("name", F.col("_r.names"), names, "ocr_fix"),
            F.when(number_fixed, F.struct(F.lit("passport_number").alias("field"), number.alias("from"), F.col("_r.number.to").alias("to"), F.col("_r.number.reason").alias("reason"))),
            _correction("nationality", nation, nation1, "ocr_fix"),
            _correction("nationality", nation1, nation2, "ocr_fix"),
        )
    )
    kinds = "array<struct<field: string, from: string, to: string, reason: string>>"

    def holds(v: Column, width: int, place: int, fixed: Column | None = None) -> Column:
        told = cut(two, place, place + 1)
        return (digit(v, width) == told) | (told == "<") | (fixed if fixed is not None else told == "")

    checks = {
        "passport_number": holds(number, 9, 9, number_fixed),
        "date_of_birth": holds(cut(two, 13, 19), 6, 19, F.col("_r.birth.corrected")),
        "expiry_date": holds(cut(two, 21, 27), 6, 27, F.col("_r.expiry.corrected")),
        "optional_data": by_format({"TD3": holds(cut(two, 28, 42), 14, 42), "TD2": holds(cut(two, 28, 36), 8, 35), "TD1": F.lit(True)}),
    }
    covered = {"TD3": F.concat(cut(two, 0, 10), cut(two, 13, 20), cut(two, 21, 43)), "TD1": F.concat(cut(two, 0, 10), cut(two, 13, 20), cut(two, 21, 28))}
    checks["composite"] = by_format({"TD3": holds(covered["TD3"], 39, 43), "TD2": checks["passport_number"], "TD1": holds(covered["TD1"], 24, 29)})
    table = F.struct(*[(F.when(known, c) if check else F.lit(None).cast("boolean")).alias(n) for n, c in checks.items()])
    record = F.struct(
        kind.alias("format"),
        *[F.when(known, c).otherwise(empty).alias(n) for n, c in fields.items()],
        F.when(known, corrections.cast(kinds)).otherwise(F.array().cast(kinds)).alias("corrections"),
        table.alias("checks"),
    )
    done = materialised(base, "_record", record)
    c = F.col("_record.checks")
    overall = F.coalesce(c["passport_number"] & c["date_of_birth"] & c["expiry_date"] & c["composite"], F.lit(False))
    return done.select(*[F.col(f"`{n}`") for n in rows.columns], F.struct("_record.*", overall.alias("overall_valid")).alias(out))


def normalised(rows: DataFrame, rules: dict[str, Column], out: str = "raw_original") -> DataFrame:
    """rows with each rule's column put in place, and the struct out of what those columns held before: the record keeps its own origin."""
    before = F.struct(*[(F.col(f"`{n}`") if n in rows.columns else F.lit(None).cast("string")).alias(n) for n in rules])
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in rules and c != out]
    return rows.select(*kept, *[c.alias(n) for n, c in rules.items()], before.alias(out))
