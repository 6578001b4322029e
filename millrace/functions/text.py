"""Names, numbers, phones, similarity, scripts and the rule language, as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.dims import ISO2_TO_ISO3, ISO3_TO_NAME


def text(v: Column) -> Column:
    return F.coalesce(v, F.lit(""))


def lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for p in table.items() for x in p])
    return F.coalesce(F.try_element_at(pairs, key), default)


def normalize_name(v: Column) -> Column:
    """Fillers are spaces, space is single, letters are upper case."""
    return F.upper(F.trim(F.regexp_replace(F.replace(text(v), F.lit("<"), F.lit(" ")), r"\s+", " ")))


def normalize_document_number(v: Column, dialect: str = "worker") -> Column:
    """worker: trailing fillers go; service: all fillers go; util: all but capitals and digits go, before upper-casing."""
    if dialect == "worker":
        return F.regexp_replace(F.upper(F.trim(text(v))), "<+$", "")
    if dialect == "service":
        return F.replace(F.upper(F.trim(text(v))), F.lit("<"), F.lit(""))
    return F.regexp_replace(text(v), "[^A-Z0-9]", "")


def normalize_gender(v: Column, unknown: str = "UNKNOWN", third: bool = False) -> Column:
    """M or F by the English and Vietnamese words; with third, X stays X."""
    up = F.upper(F.trim(text(v)))
    out = F.when(up.isin("M", "MALE", "NAM"), "M").when(up.isin("F", "FEMALE", "NỮ", "NU"), "F")
    return (out.when(up == "X", "X") if third else out).otherwise(unknown)


def normalize_country(v: Column) -> Column:
    """Three letters stay, two go through the list, longer ones are cut to three."""
    up = F.upper(F.trim(text(v)))
    return F.when(F.length(up) == 2, lookup(ISO2_TO_ISO3, up, up)).otherwise(F.substring(up, 1, 3))


def _unmarked() -> tuple[str, str]:
    """Characters that decompose into one character and marks of U+0300 to U+036F, and that character."""
    marked, plain = [], []
    for c in map(chr, range(0xC0, 0xD800)):
        parts = unicodedata.normalize("NFD", c)
        bare = "".join(p for p in parts if not "\u0300" <= p <= "\u036f")
        if parts != c and len(bare) == 1:
            marked.append(c)
            plain.append(bare)
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _unmarked()


def strip_diacritics(v: Column) -> Column:
    """Letters without their marks, precomposed or combining; đ and other letters of their own stay, and so do Hangul syllables."""
    return F.regexp_replace(F.translate(text(v), MARKED, PLAIN), "[\\u0300-\\u036f]", "")


def soundex(v: Column) -> Column:
    """Letter and three digits; vowels, H, W and Y go before coding, and the first letter is never merged with the next. Empty: 000."""
    up = F.regexp_replace(F.upper(text(v)), "[^A-Z]", "")
    rest = F.regexp_replace(F.substring(up, F.lit(2), F.length(up)), "[AEIOUHWY]", "")
    coded = F.translate(rest, "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    merged = F.regexp_replace(coded, "([0-9])\\1+", "$1")
    return F.when(up == "", "000").otherwise(F.rpad(F.concat(F.substring(up, 1, 1), F.substring(merged, 1, 3)), 4, "0"))


def fuzzy_match(a: Column, b: Column) -> Column:
    """matched, similarity, method: equal 1, equal without marks .95, alike in sound .85, else by edit distance from .7 on."""
    x, y = F.upper(F.trim(text(a))), F.upper(F.trim(text(b)))
    distance = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    sounds = (soundex(x) == soundex(y)) & (F.length(x) >= 3) & (F.length(y) >= 3)
    kinds = [(x == y, F.lit(1.0), "exact"), (strip_diacritics(x) == strip_diacritics(y), F.lit(0.95), "normalized"), (sounds, F.lit(0.85), "soundex")]
    similarity, method = distance, F.lit("levenshtein")
    for test, value, name in reversed(kinds):
        similarity, method = F.when(test, value).otherwise(similarity), F.when(test, F.lit(name)).otherwise(method)
    return F.struct((similarity >= 0.7).alias("matched"), similarity.alias("similarity"), method.alias("method"))


#: Characters that may stand for each other, looked up in capitals.
AMBIGUOUS = {"0": "O,Q,D", "O": "0", "1": "I,L,l", "I": "1,l", "5": "S", "S": "5", "8": "B", "B": "8", "2": "Z", "Z": "2", "6": "G", "G": "6", "9": "g,q"}


def ambiguity_warnings(v: Column) -> Column:
    """(char, position, suggestions) of each ambiguous character as it stands in v, positions from 0."""
    pairs = F.create_map(*[F.lit(x) for p in AMBIGUOUS.items() for x in p])
    marked = F.transform(F.split(text(v), ""), lambda c, i: F.struct(c.alias("char"), i.alias("position"), F.try_element_at(pairs, F.upper(c)).alias("suggestions")))
    return F.filter(marked, lambda s: s["suggestions"].isNotNull())


#: Scripts in the order in which they are looked for, with their code-point ranges.
SCRIPTS = {
    "CJK": "\\u4E00-\\u9FFF\\u3040-\\u30FF\\uAC00-\\uD7AF",
    "ARABIC": "\\u0600-\\u06FF",
    "CYRILLIC": "\\u0400-\\u04FF",
    "DEVANAGARI": "\\u0900-\\u097F",
    "THAI": "\\u0E00-\\u0E7F",
    "GREEK": "\\u0370-\\u03FF",
}


def non_latin_script(v: Column) -> Column:
    """The first script that more than half of the characters outside ASCII and spaces belong to, or null."""
    others = F.length(F.regexp_replace(text(v), "[\\u0000-\\u024F\\s]", ""))
    out = F.lit(None).cast("string")
    for name, span in reversed(SCRIPTS.items()):
        out = F.when((others > 0) & (F.regexp_count(text(v), F.lit(f"[{span}]")) * 2 > others), F.lit(name)).otherwise(out)
    return out


#: Cyrillic and Greek letters in Latin, in alphabetical order.
CYRILLIC = dict(zip("АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "A B V G D E E ZH Z I I K L M N O P R S T U F KH TS CH SH SHCH  Y  E IU IA".split(" "), strict=True))
GREEK = dict(zip("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "A V G D E Z I TH I K L M N X O P R S T Y F CH PS O".split(" "), strict=True))


def transliterate(v: Column) -> Column:
    """Upper-cased Cyrillic and Greek letters in Latin, one or several each; a letter without sound goes; all else stays."""
    pairs = F.create_map(*[F.lit(x) for p in (CYRILLIC | GREEK).items() for x in p])
    return F.array_join(F.transform(F.split(F.upper(text(v)), ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), "")


def transliteration_confidence(v: Column) -> Column:
    script = non_latin_script(v)
    return F.when(script.isNull(), 1.0).when(script == "CJK", 0.3).when(script == "ARABIC", 0.7).when(script == "CYRILLIC", 0.8).when(script == "GREEK", 0.8).otherwise(0.6)


def format_phone(v: Column, kind: str, country_code: str = "84") -> Column:
    """local: the last ten digits; international: + and country code, which replaces a leading 0."""
    digits = F.regexp_replace(text(v), "[^0-9]", "")
    if kind == "local":
        return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))).otherwise(digits)
    if kind != "international":
        return v
    rest = F.when(digits.startswith("0"), F.substr(digits, F.lit(2))).otherwise(digits)
    return F.when(digits.startswith(country_code), F.concat(F.lit("+"), digits)).otherwise(F.concat(F.lit("+" + country_code), rest))


def format_country(v: Column, kind: str) -> Column:
    up = F.upper(v)
    iso3 = lookup(ISO2_TO_ISO3, up, v)
    if kind == "ISO3":
        return F.when(F.length(v) == 2, iso3).otherwise(v)
    if kind == "NAME":
        return F.when(F.length(v) == 3, lookup(ISO3_TO_NAME, up, v)).when(F.length(v) == 2, lookup(ISO3_TO_NAME, F.upper(iso3), v)).otherwise(v)
    return v


def permute_date(v: Column, source: str, target: str) -> Column:
    """Dates between yyyy-MM-dd, dd/MM/yyyy, MM/dd/yyyy, yyyyMMdd by their parts alone; a text of another shape, and a pair that is not known, stay."""
    shapes = {"yyyy-MM-dd": r"^(\d{4})-(\d{2})-(\d{2})$", "dd/MM/yyyy": r"^(\d{2})/(\d{2})/(\d{4})$", "MM/dd/yyyy": r"^(\d{2})/(\d{2})/(\d{4})$", "yyyyMMdd": r"^(\d{4})(\d{2})(\d{2})$"}
    places = {"yyyy-MM-dd": (1, 2, 3), "dd/MM/yyyy": (3, 2, 1), "MM/dd/yyyy": (3, 1, 2), "yyyyMMdd": (1, 2, 3)}
    outs = {"yyyy-MM-dd": ("-", (0, 1, 2)), "dd/MM/yyyy": ("/", (2, 1, 0)), "MM/dd/yyyy": ("/", (1, 2, 0)), "yyyyMMdd": ("", (0, 1, 2))}
    if source not in shapes or target not in outs:
        return v
    parts = [F.regexp_extract(v, shapes[source], k) for k in places[source]]
    mark, order = outs[target]
    return F.when(v.rlike(shapes[source]), F.concat_ws(mark, *[parts[k] for k in order])).otherwise(v)


def apply_rule(v: Column, rule: dict) -> Column:
    """One step of the rule language; an unknown kind changes nothing."""
    kind = rule["type"]
    if kind == "trim":
        return F.trim(v)
    if kind in ("uppercase", "lowercase"):
        return F.upper(v) if kind == "uppercase" else F.lower(v)
    if kind == "titlecase":
        return F.initcap(v)
    if kind == "date_format":
        return permute_date(v, rule.get("from", ""), rule["to"])
    if kind == "gender_format":
        return lookup(rule["mapping"], F.upper(v), v)
    if kind == "country_format":
        return format_country(v, rule["format"])
    if kind == "replace":
        return F.replace(v, F.lit(rule["from"]), F.lit(rule["to"]))
    if kind == "prefix":
        return F.concat(F.lit(rule["value"]), v)
    if kind == "suffix":
        return F.concat(v, F.lit(rule["value"]))
    if kind == "custom_mapping":
        return lookup(rule["mapping"], v, v)
    if kind == "strip":
        return F.regexp_replace(v, f"[{rule['chars']}]" if rule.get("chars") else "[^a-zA-Z0-9]", "")
    if kind == "phone_format":
        return format_phone(v, rule["format"], rule.get("countryCode", "84"))
    return v


def apply_rules(v: Column, rules: list[dict]) -> Column:
    """The rules left to right, one expression."""
    return reduce(apply_rule, rules, text(v))


def apply_rules_checked(v: Column, rules: list[dict]) -> Column:
    """result, valid, broken_step: stops before the first rule that would turn a text into nothing, and tells its place."""
    result, broken = text(v), F.lit(-1)
    for k, rule in enumerate(rules):
        after = apply_rule(result, rule)
        emptied = (broken < 0) & (result != "") & (after == "")
        broken, result = F.when(emptied, k).otherwise(broken), F.when((broken >= 0) | emptied, result).otherwise(after)
    return F.struct(result.alias("result"), (broken < 0).alias("valid"), broken.alias("broken_step"))


def clean_name_tokens(v: Column) -> Column:
    """Words of letters alone, up to 15 long, and of more than two different letters once they are longer than four."""
    words = F.split(F.trim(text(v)), r"\s+")
    good = F.filter(words, lambda w: w.rlike("^[A-Za-z]{1,15}$") & ((F.length(w) <= 4) | (F.size(F.array_distinct(F.split(w, ""))) > 2)))
    return F.array_join(good, " ")


def join_codes(codes: Column, dialect: str = "worker") -> Column:
    """worker: joined by semicolons; service: by semicolon and space, null if there are none."""
    if dialect == "worker":
        return F.array_join(codes, ";")
    return F.when(F.size(codes) > 0, F.array_join(codes, "; "))


def infer_document_type(number: Column) -> Column:
    up = F.upper(F.trim(text(number)))
    return F.when(up.rlike("^[A-Z]{2}[0-9]{6,}$"), "PASSPORT").when(up.rlike("^([0-9]{9,12}|[A-Z][0-9]{8})$"), "ID_CARD").otherwise("UNKNOWN")


def clean_visual_text(v: Column, field: str) -> Column:
    """The characters that a field can have."""
    if field in ("dateOfBirth", "expiryDate", "issueDate"):
        return F.regexp_replace(text(v), "[^0-9/.-]", "")
    if field in ("passportNumber", "idNumber"):
        return F.regexp_replace(F.upper(text(v)), "[^A-Z0-9]", "")
    if field in ("fullName", "surname", "givenName"):
        return F.trim(F.regexp_replace(F.regexp_replace(text(v), "[^A-Za-zÀ-ÿ' -]", ""), " +", " "))
    return F.trim(text(v))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))
