"""Edges of the front desk's rules, of similar names, and of profiles and their mappings."""

import random

from pyspark.sql import functions as F

from millrace.functions import desk
from millrace.functions import text as tx
from millrace.operators import names, profiles


def one(spark, *columns):
    return spark.range(1).select(F.struct(*columns).alias("v")).first()["v"]


def test_passport_numbers_fit_whole(spark):
    def fits(number, nation):
        return one(spark, desk.passport_fits(F.lit(number), F.lit(nation)))[0]

    assert fits("123456789", "GB") and fits("123456789", "gbr") and not fits("123456789\n", "GBR") and not fits("12345678", "GBR")
    assert fits("e1234567", "CHN") and fits("E12345678", "CHN") and not fits("E123456", "CHN")
    assert fits("abc12", None) and fits("abc12", "XYZ") and not fits(None, None) and not fits("ab-12", "")


def test_accuracy_of_numbers(spark):
    a = one(spark, desk.passport_accuracy(F.lit("000000000"), F.lit("USA")))[0]
    assert (a["level"], a["score"], a["issues"]) == ("LOW", 0.1, ["AMBIGUOUS_CHARS", "ZERO_FILLED"])
    a = one(spark, desk.passport_accuracy(F.lit("X4437777"), F.lit("VN")))[0]
    assert (a["level"], a["score"], a["issues"]) == ("HIGH", 1.0, [])
    a = one(spark, desk.card_accuracy(F.lit(None).cast("string")))[0]
    assert (a["level"], a["score"], a["issues"]) == ("LOW", 0.3, ["INVALID_FORMAT"])


def test_choice_of_zone_lines(spark):
    def chosen(*lines):
        return one(spark, desk.zone_lines(F.array(*map(F.lit, lines)) if lines else F.array().cast("array<string>")))[0]

    name, number = "P<UTOERIKSSON<<ANNA<MARIA".ljust(44, "<"), "L898902C36UTO7408122F1204159ZE184226B<<<<<10"
    assert chosen() == [] and chosen("hello", "") == []
    assert chosen("x", name, "y", number) == [name, number]
    assert chosen(name[::-1], number[::-1]) == [name, number]
    assert chosen(name[:40], number) == [number, name[:40]] or chosen(name[:40], number) == [name[:40], number]
    assert chosen(*[f"I<UTO{k}".ljust(30, "<") for k in range(4)]) == [f"I<UTO{k}".ljust(30, "<") for k in range(3)]
    assert chosen("P<UTOA".ljust(40, "<"), "P<UTOA".ljust(40, "<")) == ["P<UTOA".ljust(40, "<")]
    assert one(spark, desk.zone_lines(F.lit(None).cast("array<string>")))[0] == []


def test_reports_name_known_options_only(spark):
    r = one(spark, desk.report(F.lit("j"), F.create_map(F.lit("apiKey"), F.lit("x"), F.lit("deleteTempFiles"), F.lit("no")), F.lit(1), F.lit(0)))[0]
    assert r["options_used"] == {"deleteTempFiles": "no"} and r["generated_at"] is None
    r = one(spark, desk.report(F.lit("j"), F.lit(None).cast("map<string,string>"), F.lit(1), F.lit(0), True))[0]
    assert r["options_used"] == {}


def test_similar_names_against_all_pairs(spark):
    """Every pair that fuzzy_match matches is a row, or both names are in one class."""
    rng = random.Random(7)
    roots = ["nguyen van an", "maria lopez", "jose", "josé", "li", "lo", "o", "anna", "abcdefghijklmnopqrstuvwxyz", "тест", "тесто", "ivan petrov"]
    made = set(roots)
    for _ in range(220):
        w = list(rng.choice(roots))
        for _ in range(rng.randint(1, 8)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "n", "x", " ", "e"])
        made.add("".join(w))
    rows = spark.createDataFrame([(v, 1) for v in [*made, *roots, " Jose ", "", None, "   "]], "name string, other int")
    found = names.similar_names(rows, "name").collect()
    got = {(r["name"], r["other"]): r for r in found}
    assert len(got) == len(found) and all(a > b for a, b in got)

    x = rows.select(F.upper(F.trim("name")).alias("x")).where("x <> ''").distinct()
    pairs = x.crossJoin(x.withColumnRenamed("x", "y")).where("x > y")
    m = tx.fuzzy_match(F.col("x"), F.col("y"))
    want = {(r["x"], r["y"]): r for r in pairs.select("x", "y", m["similarity"].alias("s"), m["method"].alias("m"), m["matched"].alias("matched")).where("matched").collect()}
    assert set(got) <= set(want) and all(got[p]["similarity"] == want[p]["s"] and got[p]["method"] == want[p]["m"] for p in got)
    least = {}
    for a, b in got:
        if got[a, b]["method"] != "levenshtein":
            least.setdefault(a, set()).add(b)
    missing = [p for p in want if p not in got and not (want[p]["m"] != "levenshtein" and (least[p[0]] & (least.get(p[1], set()) | {p[1]})))]
    assert not missing and sum(r["m"] == "levenshtein" for r in want.values()) > 100


def test_similar_names_of_nothing(spark):
    assert names.similar_names(spark.createDataFrame([], "n string"), "n").count() == 0


def test_profiles_have_one_default(spark):
    none = spark.createDataFrame([], "id int, name string, target string, is_default boolean, updated_at string")
    first = profiles.with_profile(none, 1, "a", "t1")
    both = profiles.with_profile(first, 2, "b", "t2")
    assert [(r["id"], r["is_default"]) for r in both.orderBy("id").collect()] == [(1, True), (2, False)]
    assert [(r["id"], r["is_default"], r["updated_at"]) for r in profiles.with_default(both, 2, "t3").orderBy("id").collect()] == [(1, False, "t3"), (2, True, "t3")]


def test_edits_of_mappings(spark):
    base = spark.createDataFrame([(1, m, "old") for m in "abcd"], "profile_id int, mapping_id string, f string")
    edits = [
        (1, "a", "update", 1, "new"), (1, "a", "update", 2, "newer"), (1, "b", "remove", 1, None), (1, "b", "update", 2, "late"),
        (1, "c", "remove", 1, None), (1, "c", "add", 2, "again"), (1, "x", "update", 1, "none"), (1, "y", "add", 1, "y"), (1, "y", "rename", 2, "?"),
        (None, "a", "remove", 9, None), (1, "z", "update", 1, "early"), (1, "z", "add", 2, "z"),
    ]
    e = spark.createDataFrame(edits, "profile_id int, mapping_id string, op string, at int, f string")
    got = {r["mapping_id"]: r["f"] for r in profiles.edited_mappings(base, e, ["f"]).collect()}
    assert got == {"a": "newer", "c": "again", "d": "old", "y": "y", "z": "z"}
    assert profiles.edited_mappings(base, e.limit(0), ["f"]).count() == 4


def test_invalid_mappings_give_way_to_defaults(spark):
    p = spark.createDataFrame([(k,) for k in range(5)], "id int")
    m = [(0, "a", "x", True, True), (1, "a", " ", True, True), (2, "a", "x", True, True), (2, "a", "y", True, True), (3, "b", "x", True, True), (3, None, "x", True, True)]
    rows = spark.createDataFrame(m, "profile_id int, source string, target string, required boolean, enabled boolean")
    got = profiles.mappings_or_defaults(p, rows, [{"source": "a", "required": True}], ["a", "b"]).collect()
    assert sorted((r["profile_id"], r["source"], r["target"], r["stored"]) for r in got) == [(0, "a", "x", True), *[(k, "a", "a", False) for k in (1, 2, 3, 4)]]


def test_ambiguous_characters(spark):
    def found(v):
        return [(w["char"], w["position"], w["suggestions"]) for w in spark.range(1).select(tx.ambiguity_warnings(F.lit(v).cast("string")).alias("v")).first()["v"]]

    assert found("CDEFHJKLQ") == found("") == found(None) == []
    assert found("aI0") == [("I", 1, "1,l"), ("0", 2, "O,Q,D")]
    assert found("g9") == [("g", 0, "6"), ("9", 1, "g,q")]
