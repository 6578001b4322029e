"""The visual reader: labelled values on a line or the next one, transliterated, with the zone's values laid over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import mrz
from millrace.functions import text as texts

#: The labels of each field, in the order in which they are tried; the value is the group.
PATTERNS = {
    "passport_number": [
        r"PASSPORT\s*(?:NO|N[.:]?|#)?\s*[A-Z]?\s*[A-Z]{3}\s*([A-Z0-9]+)",
        r"PASSPORT\s*N[O°]?[.:]?\s*([A-Z0-9]+)",
        r"(?:PASSPORT\s*NO\.?|PASSPORT\s*#|DOCUMENT\s*NO\.?|DOCUMENT\s*#)\s*([A-Z0-9]+)",
        r"NO\.?\s*([A-Z0-9]{5,15})\b",
    ],
    "surname": [r"(?:SURNAME|SUR\b|SURNOM|APELLIDO|NACHNAME|COGNOME|SOBRENOME|姓氏|ФАМИЛИЯ|姓)\s*[.:]?\s*(.+)"],
    "given_name": [r"GIVEN\s*NAMES?[.:]?\s*(.+)", r"(?:GIVEN\s*NAMES?|PRENOM|NOMBRE|VORNAME|NOME|NOME\s*PROPRIO|名字|ИМЯ|名)\s*[.:]?\s*(.+)"],
    "nationality": [r"NATIONALITY[.:]?\s*([A-Z]+)", r"(?:NATIONALITY|NATIONALITÉ|NACIONALIDAD|STAATSANGEHÖRIGKEIT|NAZIONALITÀ|国籍|ГРАЖДАНСТВО)\s*[.:]?\s*([A-Z]+)"],
    "date_of_birth": [
        r"DATE\s*OF\s*BIRTH[.:]?\s*([\d/.-]+)",
        r"(?:DATE\s*OF\s*BIRTH|DATE\s*DE\s*NAISSANCE|FECHA\s*DE\s*NACIMIENTO|GEBURTSDATUM|DATA\s*DI\s*NASCITA|出生日期|ДАТА\s*РОЖДЕНИЯ)\s*[.:]?\s*([\d/.-]+)",
    ],
    "expiry_date": [
        r"DATE\s*OF\s*EXPIRY[.:]?\s*([\d/.-]+)",
        r"(?:DATE\s*OF\s*EXPIRY|DATE\s*D[']?EXPIRATION|FECHA\s*DE\s*VENCIMIENTO|ABLAUF DATUM|DATA\s*DI\s*SCADENZA|有效期限|ДАТА\s*ИСТЕЧЕНИЯ)\s*[.:]?\s*([\d/.-]+)",
    ],
}
#: Labels that stand alone, their value being on the next line; a date as it can stand there.
ALONE = {
    "surname": [r"(?:HO|SURNAME|SURNOM|APELLIDO|NACHNAME)\s*/?\s*(?:SURNAME)?\s*$"],
    "given_name": [r"(?:GIVEN\s*NAMES?|PRENOM|NOMBRE|VORNAME|NOME)\s*$", r"TEN\s*/?\s*GIVEN"],
    "date_of_birth": [r"DATE\s*OF\s*BIRTH|DATE\s*DE\s*NAISSANCE|FECHA\s*DE\s*NACIMIENTO|GEBURTSDATUM"],
}
NEXT_DATE = r"(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})"
BREAKS = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C-\\u001E\\u0085\\u2028\\u2029]"
FIELDS = (*PATTERNS, "full_name")


def split_lines(v: Column) -> Column:
    return F.split(mrz.text(v), BREAKS)


def _accepted(name: str, found: Column) -> Column:
    """What is taken of the value that a label's pattern found, null if nothing."""
    v = F.trim(found)
    if name == "passport_number":
        v = F.regexp_replace(v, "[^A-Z0-9]", "")
        return F.when(F.length(v) >= 6, v)
    if name in ("surname", "given_name"):
        v = F.trim(F.regexp_replace(v, "[^A-Z a-zÀ-ÿ]", ""))
        return F.when(~F.upper(v).isin("", "S", "NAME", "NAMES"), v)
    return F.when(F.length(v) <= 5, v) if name == "nationality" else v


def labelled_fields(v: Column) -> Column:
    """The FIELDS of a text as a struct of strings, empty where none is found.

    A field's value is that of the first line, in order, that gives one: behind the first of its labels that the line
    has, or, where that gives none and a label stands alone, on the next line. The full name is surname and given
    name, or the surname. Sex is not read from labels: the zone gives it, or it is unknown. A null text has no field.
    """
    lines = F.transform(split_lines(v), lambda s: F.upper(F.trim(s)))

    def one(name: str) -> Column:
        def at(all_lines: Column):
            def candidate(line: Column, k: Column) -> Column:
                by_label = reduce(lambda rest, p: F.when(line.rlike(p), _accepted(name, F.regexp_extract(line, p, 1))).otherwise(rest), reversed(PATTERNS[name]), F.lit(None).cast("string"))
                if name not in ALONE:
                    return by_label
                behind = F.try_element_at(all_lines, k + 2)
                if name == "date_of_birth":
                    value = F.nullif(F.regexp_extract(behind, NEXT_DATE, 1), F.lit(""))
                else:
                    cleaned = F.regexp_replace(behind, "[^A-Z ]", "")
                    value = F.when((F.length(cleaned) > 0) & (F.length(cleaned) <= 30), cleaned)
                alone = reduce(lambda a, b: a | b, [line.rlike(p) for p in ALONE[name]])
                return F.coalesce(by_label, F.when(alone, value))

            return F.try_element_at(F.filter(F.transform(all_lines, candidate), lambda c: c.isNotNull()), F.lit(1))

        return F.coalesce(F.element_at(F.transform(F.array(lines), at), 1), F.lit(""))

    return F.struct(*[one(name).alias(name) for name in PATTERNS])


def with_full_name(fields: Column) -> Column:
    whole = F.when((fields["surname"] != "") & (fields["given_name"] != ""), F.concat(fields["surname"], F.lit(" "), fields["given_name"])).otherwise(fields["surname"])
    return F.struct(*[fields[n].alias(n) for n in PATTERNS], whole.alias("full_name"))


def transliterated(fields: Column, script: Column) -> Column:
    """fields with names outside ASCII in Latin letters, where the country's script is another one and the transliteration is trusted more than half."""
    names = ("surname", "given_name", "full_name")

    def latin(v: Column) -> Column:
        foreign = ~v.rlike(r"^[\x00-\x7F]*$") & F.coalesce(script != "LATIN", F.lit(False)) & (texts.transliteration_confidence(v) > 0.5)
        return F.when(foreign, texts.transliterate(v)).otherwise(v)

    return F.struct(*[(latin(fields[n]) if n in names else fields[n]).alias(n) for n in FIELDS])


def zone_lines(v: Column) -> Column:
    """The two neighbouring lines that look most like a zone, in 44 characters each, the first pair of equals; null if no pair does."""
    cleaned = F.transform(split_lines(v), lambda s: F.regexp_replace(F.upper(s), "[^A-Z0-9<]", ""))

    def pairs(lines: Column) -> Column:
        def scored(one: Column, k: Column) -> Column:
            two = F.coalesce(F.try_element_at(lines, k + 2), F.lit(""))
            points = [
                F.when(one.startswith("P<"), 30).when(one.startswith("P") & (F.length(one) > 2), 10),
                F.when(F.length(F.regexp_replace(one, "[^<]", "")) >= 5, 10),
                F.when(F.length(one) >= 40, 20),
                F.when(F.length(two) >= 40, 20),
                F.when(F.length(F.regexp_replace(two, "[^0-9]", "")) >= 10, 15),
            ]
            total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0)) for p in points])
            fits = (F.length(one) >= 20) & (F.length(two) >= 20) & (total > 0)
            return F.when(fits, F.struct((-total).alias("low"), k.alias("at"), F.rpad(one, 44, "<").alias("l1"), F.rpad(two, 44, "<").alias("l2")))

        return F.array_min(F.filter(F.transform(lines, scored), lambda p: p.isNotNull()))

    return F.element_at(F.transform(F.array(cleaned), pairs), 1)


def clean_name(v: Column) -> Column:
    """The words of letters alone, 15 at most, that are no run of one or two letters."""
    words = F.filter(F.split(F.trim(F.replace(v, F.lit("<"), F.lit(" "))), r"\s+"), lambda w: w.rlike(r"^\p{L}{1,15}$"))

    def varied(w: Column) -> Column:
        letters = F.size(F.array_distinct(F.split(w, "")))
        return ~((letters < 3) & (F.length(w) > 3)) & (letters > 1)

    return F.array_join(F.filter(words, varied), " ")
