"""Functions on stated vectors, in each dialect."""

import itertools

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, masks, mrz, rules
from millrace.functions import text as tx


@pytest.fixture
def one(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return value


def brute_digit(v):
    values = {c: k for k, c in enumerate(mrz.ALPHABET)} | {"<": 0}
    return str(sum(values[c] * w for c, w in zip(v, itertools.cycle((7, 3, 1)))) % 10)


@pytest.mark.parametrize("v,digit", [("AB123456<", "4"), ("851010", "5"), ("", "0"), ("<<<<", "0")])
def test_check_digit(one, v, digit):
    assert one(mrz.check_digit(F.lit(v))) == digit == brute_digit(v)


def test_count_of_zone_lines(one):
    letters = "ab C<1" * 4
    for raw in (None, "", "\n", letters, letters[:22], f"{letters}\n\n{letters}\r{letters}\u2028x\n", "ß" * 10, "ß" * 9 + "é.x\n" + "é" * 50, f"\n {'é ' * 30}{letters}\nabc\n{letters}", "A" * 19 + "\n" + "A" * 20):
        v = F.lit(raw).cast("string")
        kept = one(F.size(F.filter(mrz.clean_lines(v), lambda s: mrz.is_mrz_line(s))))
        assert one(mrz.count_mrz_lines(v)) == kept and one(mrz.has_mrz_pattern(v)) is (kept >= 2), raw


def test_check_digit_of_any_length(one):
    for n in (14, 15, 16, 30, 31, 39, 44, 100):
        v = "".join((mrz.ALPHABET + "<")[k * k % 37] for k in range(n))
        assert one(mrz.check_digit(F.lit(v))) == one(mrz.check_digit(F.lit(v), "service")) == brute_digit(v), n
        assert one(mrz.check_digit(F.lit(v + "é"))) is None and one(mrz.check_digit(F.lit("é" + v), "service")) == brute_digit("0" + v)


def test_check_digit_dialects(one):
    assert one(mrz.check_digit(F.lit("a1"))) is None and one(mrz.check_digit(F.lit("a1"), "service")) == "3"
    assert one(mrz.digit_ok(F.lit("X"), F.lit("<"))) is True
    assert one(mrz.digit_ok(F.lit("X"), F.lit(""))) is False and one(mrz.digit_ok(F.lit("X"), F.lit(""), "service")) is True


def test_formats(one):
    def fmt(a, b, c, dialect="worker"):
        return one(mrz.line_format(F.lit("A" * a), F.lit("A" * b), F.lit("A" * c), dialect))

    assert (fmt(44, 44, 0), fmt(36, 36, 0), fmt(30, 30, 30), fmt(29, 44, 0)) == ("TD3", "TD2", "TD1", None)
    assert (fmt(38, 38, 30), fmt(38, 38, 30, "service")) == ("TD1", "TD2")


def test_names(one):
    assert one(mrz.name_parts(F.lit("NGUYEN<<VAN<A<<<<"))).asDict() == {"surname": "NGUYEN", "given_names": "VAN A", "full_name": "NGUYEN VAN A"}
    assert one(mrz.name_parts(F.lit("SOLO<<<<"))).asDict()["full_name"] == "SOLO"
    assert one(mrz.name_parts(F.lit(None).cast("string"))).asDict()["full_name"] == ""


@pytest.mark.parametrize("v,pivot,strict,out", [("750101", 69, True, "1975-01-01"), ("500101", 69, True, "2050-01-01"), ("500101", 49, False, "1950-01-01"), ("010230", 69, True, ""), ("010230", 49, False, "2001-02-30"), ("75<<01", 69, True, ""), ("7<0101", 69, True, "1970-01-01"), ("<<<<<<", 69, True, ""), ("abc", 69, True, ""), ("", 69, True, "")])
def test_mrz_dates(one, v, pivot, strict, out):
    assert one(mrz.mrz_date(F.lit(v), pivot, strict)) == out


def test_repair(one):
    r = one(mrz.repair_field(F.lit("ABI23456<"), F.lit(brute_digit("AB123456<"))))
    assert (r["value"], r["repaired"]) == ("AB123456<", True)
    whole = one(mrz.repair_field(F.lit("AB123456<"), F.lit("4")))
    assert (whole["value"], whole["repaired"]) == ("AB123456<", False)
    lost = one(mrz.repair_field(F.lit("ACDEFG"), F.lit("9")))
    assert not lost["repaired"] and lost["value"] == "ACDEFG"


def test_all_substitutions(one):
    got = one(mrz.all_substitutions(F.lit("A0I")))
    assert got == sorted("A" + a + b for a in "0O" for b in "I1") and one(mrz.all_substitutions(F.lit(""))) == [""]
    want = brute_digit("A018")
    best = one(mrz.best_substitution(F.lit("AOIB"), F.lit(want)))
    assert brute_digit(best) == want


def test_td2_and_td1(one):
    number, birth, expiry = "AB123456<", "740812", "250415"
    line2 = number + brute_digit(number) + "VNM" + birth + brute_digit(birth) + "M" + expiry + brute_digit(expiry)
    td2 = line2 + "<" * 7 + "0"
    checks = one(mrz.validate(F.lit(td2), F.lit("TD2")))
    assert checks["composite"] and checks["optional_data"] and checks["errors"] == []
    td1 = one(mrz.validate(F.lit(line2 + "<<"), F.lit("TD1")))
    assert td1["composite"] and td1["errors"] == []
    assert one(mrz.validate(F.lit(td2), F.lit(None).cast("string")))["errors"][0] == "PASSPORT_NUMBER_CHECK_FAILED"


def test_line_detection(one):
    assert one(mrz.clean_lines(F.lit("p<vnm nguyen<<van<a<<<<\nshort"))) == ["P<VNMNGUYEN<<VAN<A<<<<"]
    assert one(mrz.is_mrz_line(F.lit("A" * 18 + "!!"))) is True and one(mrz.is_mrz_line(F.lit("A" * 17 + "!!!"))) is False
    assert one(mrz.is_mrz_line(F.lit("a b" * 10), "service")) is False and one(mrz.is_mrz_line(F.lit("ab" * 15), "service")) is True
    assert one(mrz.line_pair_score(F.lit("P<A" + "<" * 41), F.lit("1" * 44))) == 40 + 40 + 20 + 5 + 10 + 5


@pytest.mark.parametrize("v,out", [("Tymczak", "T520"), ("Pfister", "P123"), ("", "000"), ("Robert", "R163"), ("Rupert", "R163")])
def test_soundex(one, v, out):
    assert one(tx.soundex(F.lit(v))) == out


def test_fuzzy(one):
    def match(a, b):
        r = one(tx.fuzzy_match(F.lit(a), F.lit(b)))
        return r["matched"], round(r["similarity"], 2), r["method"]

    assert match("Anna", "anna ") == (True, 1.0, "exact") and match("José", "Jose") == (True, 0.95, "normalized")
    assert match("Robert", "Rupert") == (True, 0.85, "soundex") and match("abcd", "wxyz")[0] is False


def test_scripts(one):
    assert [one(tx.non_latin_script(F.lit(v))) for v in ("plain é", "Привет", "中文", "Ελλάδα", "")] == [None, "CYRILLIC", "CJK", "GREEK", None]
    assert one(tx.transliterate(F.lit("Щука Ψ x"))) == "SHCHUKA PS X"


def test_dates_by_dialect(one):
    worker = {"20101112": "1112-10-20", "31/12/2020": "2020-12-31", "12/31/2020": "2020-12-31", "2020.1.5": "2020-01-05", "900101": "1990-01-01", "x": "x", "": "", "1/2/99": "1999-02-01"}
    assert {v: one(dates.normalize_date(F.lit(v))) for v in worker} == worker
    assert one(dates.normalize_date(F.lit("690101"), "service")) == "1969-01-01" and one(dates.normalize_date(F.lit("490101"), "service")) == "2049-01-01"
    assert one(dates.normalize_date(F.lit("born 05-06-2001 in"), "util")) == "2001-06-05" and one(dates.normalize_date(F.lit("nothing"), "util")) is None


def test_date_rules(one):
    assert one(dates.expiry_state(F.lit("2024-05-31"), "2024-06-01")) == "EXPIRED" and one(dates.expiry_state(F.lit("2024-09-01"), "2024-06-01")) == "EXPIRING"
    assert one(dates.expiry_state(F.lit("bad"), "2024-06-01")) == "UNKNOWN" and one(dates.age_years(F.lit("2000-06-02"), "2024-06-01")) == 23
    assert one(dates.date_rule(F.lit("2024-07-01"), "2024-06-01", past=True)) == "NOT_PAST" and one(dates.date_rule(F.lit("1999-01-01"), "2024-06-01", past=True)) is None


def test_masks(one):
    assert one(masks.mask_start(F.lit("AB123456"))) == "AB12****" and one(masks.mask_start(F.lit("AB1"))) == "AB1"
    assert one(masks.mask_full_name(F.lit("Nguyen  Van An"))) == "Nguyen Van A*" and one(masks.mask_mrz(F.lit("P<VNMNGUYEN<<"))) == "P<VNM****<"
    assert one(masks.strip_sensitive(F.lit("C1234567 B12345678, 123456789 01/02/2000 1234 5678 1234 5678"))) == "C1234567 ***REDACTED***, ***REDACTED*** ***REDACTED*** ***REDACTED***"


def test_rules(one):
    rule = {"required": True, "min_length": 2, "max_length": 3, "pattern": "^[A-Z]+$"}
    assert [one(rules.field_issues(F.lit(v), rule)) for v in ("", "A", "ABCD", "a1", "AB")] == [["REQUIRED"], ["TOO_SHORT"], ["TOO_LONG"], ["PATTERN"], []]
    assert one(rules.all_present_true(F.create_map(F.lit("a"), F.lit(True)), ("a", "b"))) is True
    assert one(rules.review_status(F.lit(True), F.lit(False), F.lit(False), F.lit(0)))["status"] == "AUTO_FILLED"
    assert one(rules.quality_penalty(F.array(*map(F.lit, ["BLURRY", "GLARE", "TOO_DARK"])))) == 0.3
    assert [one(rules.level(F.lit(s))) for s in (0.95, 0.7, 0.1)] == ["HIGH", "MEDIUM", "LOW"]


def test_rule_language(one):
    checked = one(tx.apply_rules_checked(F.lit(" 12 "), [{"type": "trim"}, {"type": "strip", "chars": "0-9"}, {"type": "uppercase"}]))
    assert (checked["result"], checked["valid"], checked["broken_step"]) == ("12", False, 1)
    assert one(tx.apply_rules(F.lit("o'neil jean-luc"), [{"type": "titlecase"}])) == "O'neil Jean-luc"
    assert one(tx.apply_rules(F.lit("m"), [{"type": "gender_format", "mapping": {"M": "Male"}}, {"type": "nonsense"}])) == "Male"
    assert one(tx.apply_rules(F.lit("2020-01-31"), [{"type": "date_format", "from": "yyyy-MM-dd", "to": "dd/MM/yyyy"}])) == "31/01/2020"
    assert one(tx.format_phone(F.lit("0912 345 678"), "international")) == "+84912345678" and one(tx.format_phone(F.lit("+84 912 345 678"), "local")) == "4912345678"[-10:]


def test_long_values_are_whole(spark):
    line, digits = F.lit("P<UTO" + "A" * 300 + "<<B"), F.lit("0" + "1" * 300)
    r = spark.range(1).select(mrz.parse(line, F.lit(""), F.lit(""), F.lit("TD3"))["surname"].alias("s"), tx.format_phone(digits, "international").alias("p")).first()
    assert r["s"] == "A" * 300 and r["p"] == "+84" + "1" * 300
