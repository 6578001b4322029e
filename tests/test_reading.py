"""Zones with lineage, staged passes, near pairs, aligned confidence, boxes, classes by rules, visual records, stored logs and keyed tables."""

import itertools
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import lineage
from millrace.operators import reading
from millrace.plans.reading import layout_rules
from millrace.sources import tables

NUMBER, DATE = {"O": "0", "0": "O", "I": "1", "1": "I"}, {"O": "0", "0": "O", "I": "1", "1": "I", "L": "1", "Z": "2", "S": "5", "B": "8", "G": "6"}


def digit(v):
    values = [int(c) if c.isdigit() else ord(c) - 55 if "A" <= c <= "Z" else 0 for c in v]
    return str(sum(x * (7, 3, 1)[k % 3] for k, x in enumerate(values)) % 10)


def subsets(v, swaps):
    return sorted({"".join(p) for p in itertools.product(*[{c, swaps.get(c, c)} for c in v])})


def iso(v):
    if not re.fullmatch(r"\d{6}", v) or not (1 <= int(v[2:4]) <= 12 and 1 <= int(v[4:]) <= 31):
        return ""
    return f"{'20' if int(v[:2]) <= 49 else '19'}{v[:2]}-{v[2:4]}-{v[4:]}"


def number_fix(v, told):
    if told in ("", "<") or digit(v) == told:
        return None
    return next((c for swaps in (NUMBER, DATE) for c in subsets(v, swaps) if c != v and digit(c) == told), None)


def date_fix(v, told):
    blank = told in ("", "<")
    if iso(v) and (blank or digit(v) == told):
        return iso(v), False
    fits = [] if blank else [iso(c) for c in subsets(v, DATE) if c != v and digit(c) == told and iso(c)]
    swapped = v.translate(str.maketrans("SBG", "586"))
    found = fits[0] if fits else iso(swapped) if swapped != v else ""
    return (found, True) if found else (iso(v), False)


def test_repairs_against_all_subsets(spark):
    rng = random.Random(5)
    rows = [("".join(rng.choices("O0I1LZSBG2586<A", k=9)), "".join(rng.choices("O0I1LZSBG258", k=6)), rng.choice([*"0123456789", "<", ""])) for _ in range(400)]
    rows += [("AB1234567", "740812", digit("740812")), ("", "", "3")]
    frame = spark.createDataFrame(rows, "num string, day string, told string")
    got = frame.select("num", "day", "told", lineage.repaired_number(F.col("num"), F.col("told"))["to"], lineage.repaired_date(F.col("day"), F.col("told"), 49), lineage.digit(F.col("num"), 9)).collect()
    for r in got:
        assert r[3] == number_fix(r["num"], r["told"])
        assert tuple(r[4]) == date_fix(r["day"], r["told"])
        assert r[5] == digit(r["num"])


def test_records_of_odd_zones(spark):
    l1, number = "P<UTOERIKSSON<<ANNA<MAR1A<<<<<<<<<<<<<<<<<<<", "L898902C3"
    l2 = number + digit(number) + "UTO740812" + digit("740812") + "F120415" + digit("120415") + "ZE184226B<<<<<1"
    l2 += digit(l2[:10] + l2[13:20] + l2[21:43])
    rows = [(0, [l1, None, " ", l2]), (1, None), (2, [l1]), (3, ["SHORT", "LINES"]), (4, [" " + l1 + " ", l2 + "<<<"])]
    frame = spark.createDataFrame(rows, "k long, lines array<string>")
    got = {r["k"]: r["record"] for r in lineage.repaired_records(frame, "lines").collect()}
    assert got[0]["format"] == "TD3" and got[0]["overall_valid"] and tuple(got[0]["given_name"]) == ("ANNA MARIA", l1[5:].replace("1", "I"), True, True)
    assert [tuple(c) for c in got[0]["corrections"]] == [("name", l1[5:], l1[5:].replace("1", "I"), "ocr_fix")]
    assert got[4] == got[0]
    for k in (1, 2, 3):
        assert got[k]["format"] == "UNKNOWN" and got[k]["corrections"] == [] and not got[k]["overall_valid"] and tuple(got[k]["surname"]) == ("", "", False, False)
    hurt = l2.replace("740812", "74O8I2").replace("L898", "L8S8")
    frame = spark.createDataFrame([(0, [l1, hurt])], "k long, lines array<string>")
    plain = lineage.repaired_records(frame, "lines", correct=False).first()["record"]
    assert tuple(plain["date_of_birth"]) == ("", "74O8I2", False, False) and not plain["checks"]["date_of_birth"]
    blind = lineage.repaired_records(frame, "lines", check=False).first()["record"]
    assert blind["checks"]["date_of_birth"] is None and tuple(blind["date_of_birth"]) == ("1974-08-12", "74O8I2", True, True)
    assert lineage.repaired_records(frame.limit(0), "lines").count() == 0


def test_near_pairs(spark):
    rng = random.Random(2)
    rows = [(g, p, rng.random()) for g in (1, 2, None) for p in rng.sample(range(-60, 60), 50)] + [(1, None, 0.5), (2, 7, 0.1), (2, 7, 0.2)]
    frame = spark.createDataFrame(rows, "g int, p int, v double")
    found = reading.near_pairs(frame, ["g"], "p", 20)
    got = sorted((r["g"], r["a"]["p"], r["b"]["p"], r["a"]["v"], r["b"]["v"]) for r in found.collect())
    assert got == sorted((g, p, q, v, w) for g, p, v in rows for h, q, w in rows if g is not None and g == h and p is not None and q is not None and p < q < p + 20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_crossings_of_groups_without_pairs(spark):
    frame = spark.createDataFrame([(1, 0, 0, 0, 10, 0), (1, 1, 0, 0, 0, 10), (1, 25, 0, 0, 10, 10), (2, 0, 0, 0, 1, 1)], "g int, p int, x1 int, y1 int, x2 int, y2 int")
    got = {r["g"]: (r["crossed"], r["score"]) for r in reading.crossings(frame, ["g"], "p", F.lit(3), F.lit(4)).collect()}
    assert got == {1: (1, 0.2), 2: (0, 0.0)}


def test_later_stages_see_the_remainder_only(spark):
    seen, plans = {}, {}

    def stage(name, test):
        def run(rows):
            seen[name] = sorted(r["k"] for r in rows.collect())
            plans[name] = rows._jdf.queryExecution().optimizedPlan().toString()
            return rows.where(test).select("k", F.col("v").alias("score"), F.lit(name).alias("value"))

        return run

    frame = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 3.0), (3, None), (None, 9.0)], "k int, v double")
    best, rest = reading.staged(frame.where("k is not null"), "k", {"one": stage("one", F.col("v") > 4), "two": stage("two", F.col("v") > 2), "three": stage("three", F.col("v") > 100)})
    assert seen == {"one": [1, 2, 2, 3], "two": [2, 2, 3], "three": [3]}
    assert "LeftAnti" in plans["two"] and "LeftAnti" not in plans["one"]
    assert sorted(tuple(r) for r in best.select("k", "score", "stage", "fallback").collect()) == [(1, 5.0, "one", False), (2, 3.0, "two", True)]
    assert [r["k"] for r in rest.collect()] == [3]


def test_confidence_of_whole_lines_and_pieces(spark):
    td1 = ["I<UTOERIKSSON<<ANNA<MARIA<<<<<", "D231458907UTO7408122F1204159<6", "SECOND<LINE<<<<<<<<<<<<<<<<<<<"]
    td3 = ["P<UTO" + "<" * 39, "L898902C36UTO7408122F1204159" + "<" * 16, None]
    lines = spark.createDataFrame([(k, n + 1, t) for k, zone in enumerate((td1, td3)) for n, t in enumerate(zone) if t], "k int, line int, text string")
    spans = spark.createDataFrame([(0, 1, 0, 30, 0.9), (0, 2, 0, 30, 0.5), (0, 3, 0, 30, 0.7), (1, 1, 0, 44, 0.8), (1, 2, 0, 3, 0.2), (1, 2, 3, 9, 0.8)], "k int, line int, start int, end int, confidence double")
    got = {(r["k"], r["field"]): (r["value"], round(r["confidence"], 6)) for r in reading.aligned_confidence(lines, spans, "k").collect()}
    assert len(got) == 20
    assert got[0, "surname"] == ("ERIKSSON", 0.9) and got[0, "full_name"] == ("ERIKSSON ANNA MARIA", 0.9) and got[0, "given_name"] == ("ANNA MARIA", 0.9)
    assert got[0, "optional_data"] == ("6SECOND LINE", 0.6)
    assert got[1, "surname"] == ("", 0.5) and got[1, "passport_number"] == ("L898902C3", 0.6) and got[1, "nationality"] == ("UTO", 0.0) and got[1, "optional_data"] == ("", 0.0)


def test_lines_of_boxes_drop_doubtful_and_short_ones(spark):
    rows = [(1, 50.0, 0.0, 10.0, "cd ef<ghijklm", 0.9), (1, 0.0, 1.0, 11.0, "a b", 0.5), (1, 20.0, 0.0, 10.0, "XX", 0.4), (1, 30.0, 0.0, 10.0, "YY", None), (1, 0.0, 40.0, 50.0, "SHORT", 0.9), (2, 0.0, 0.0, 10.0, "é12345678901234-5", 0.8), (2, 9.0, None, 10.0, "LOST", 0.8)]
    frame = spark.createDataFrame(rows, "page int, left double, top double, bottom double, text string, confidence double")
    got = {r["page"]: (r["line"], r["text"], round(r["confidence"], 6)) for r in reading.lines_of_boxes(frame, ["page"], least=12).collect()}
    assert got == {1: (1, "ABCDEF<GHIJKLM", 0.7), 2: (1, "123456789012345", 0.8)}


def test_classes_by_rules(spark):
    rows = [(1, 1.5, 0.2, 0.5, 0.5, 0.5, None), (2, 1.5, 0.0, 0.9, 0.1, 0.6, None), (3, 9.0, 0.0, 0.9, 0.5, 0.1, None), (4, 1.5, 0.2, 0.5, 0.5, 0.5, "ID_CARD"), (5, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "k int, ratio double, bottom_share double, top_share double, edge_density double, white_ratio double, mode string")
    features = ["ratio", "bottom_share", "top_share", "edge_density", "white_ratio"]
    got = {r["k"]: (r["label"], r["points"], len(r["signals"]), round(r["share"], 3)) for r in reading.classified(frame, ["k"], layout_rules(spark), features, forced="mode").collect()}
    assert got == {1: ("PASSPORT", 80, 3, 0.696), 2: ("ID_CARD", 50, 3, 0.625), 3: (None, 0, 0, 0.0), 4: ("ID_CARD", 100, 1, 1.0), 5: (None, 0, 0, 0.0)}
    ranked = reading.classified(frame.where("k = 2"), ["k"], layout_rules(spark), features, top=2).collect()
    assert [(r["label"], r["rank"]) for r in sorted(ranked, key=lambda r: r["rank"])] == [("ID_CARD", 1), ("PASSPORT", 2)]


def test_visual_records(spark):
    number = "AB1234567"
    l1 = "P<UTOSMITHSON<<JOHN<AAAA<X<PETER<<<<<<<<<<<<"
    l2 = number.replace("1", "I") + digit(number) + "UTO740812" + digit("740812") + "M310415" + digit("310415") + "<" * 15 + "0"
    texts = [
        "Passport No. X12-99\nSurname: Lee\nGiven names: Ann-Marie 2\nNationality: Utopian\nNationality GBR\nDate of birth: 01/02/1980\nSex: M",
        "HO / SURNAME\n  o'neil  \nPRENOM\n123\nGIVEN NAMES\nzoë\nFecha de nacimiento\nborn 3-4-77",
        f"Surname: Visual\n{l1.lower()}\n{l2}",
        "ФАМИЛИЯ: Иванова",
        None,
        "",
    ]
    frame = spark.createDataFrame([(k, t, "CYRILLIC" if k == 3 else None) for k, t in enumerate(texts)], "k int, text string, script string")
    got = {r["k"]: r["record"] for r in reading.visual_records(frame, "text", "script").collect()}
    assert (got[0]["passport_number"], got[0]["surname"], got[0]["given_name"], got[0]["nationality"], got[0]["date_of_birth"], got[0]["gender"]) == ("", "LEE", "ANNMARIE", "GBR", "01/02/1980", "UNKNOWN")
    assert (got[1]["surname"], got[1]["given_name"], got[1]["date_of_birth"]) == ("ONEIL", "ZO", "3-4-77")
    assert (got[2]["surname"], got[2]["given_name"], got[2]["passport_number"], got[2]["gender"], got[2]["date_of_birth"], got[2]["zone_found"]) == ("SMITHSON", "JOHN PETER", number, "M", "1974-08-12", True)
    assert got[3]["surname"] == "" and got[4]["full_name"] == "" and got[5]["gender"] == "UNKNOWN"


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_expired_days_go_and_others_stay_as_they_are(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(k, f"2024-01-{1 + k % 10:02d} {k % 24:02d}:30:00") for k in range(240)] + [(999, None)]
    events = spark.createDataFrame(rows, "event_id int, at string").select("event_id", F.to_timestamp("at").alias("ts"))
    tables.write_log(events, path)
    before = files(path)
    assert tables.expire(spark, path, "2024-02-04 12:00:00", 30) == 4
    after = files(path)
    assert {f for f in after if "day=2024-01-05" not in f} == {f for f in before if not any(f"day=2024-01-0{d}" in f for d in range(1, 6))}
    assert all(after[f] == before[f] for f in after if f in before)
    left = {r["event_id"] for r in tables.read_log(spark, path).collect()}
    assert left == {k for k, at in rows if at is None or at >= "2024-01-05 12:00:00"}
    assert tables.expire(spark, path, "2024-02-04 12:00:00", 30) == 0
    tables.expire(spark, path, "2030-01-01 00:00:00", 1)
    assert [r["event_id"] for r in tables.read_log(spark, path, events).collect()] == [999]
    assert tables.by_type(events.withColumns({"user_id": F.lit(1), "event_type": F.lit("a")}), 1, "a").count() == 241


def test_a_key_reads_one_file(spark, tmp_path):
    path = str(tmp_path / "keyed")
    frame = spark.range(5000).select("id", (F.col("id") % 7).cast("string").alias("kind"), F.when(F.col("id") < 3, F.lit("rare")).otherwise("often").alias("how"))
    tables.write_keyed(frame, path, "id", 32, ("how",))

    def opened(df):
        plan = df._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        leaves = plan.collectLeaves()
        return [leaves.apply(k).metrics().get("numFiles").get().value() for k in range(leaves.size())]

    one = tables.by_key(spark, path, "id", 1234, 32)
    assert [r["id"] for r in one.collect()] == [1234] and opened(one) == [1]
    rare = tables.by_index(spark, path, "how", "rare", 32)
    assert sorted(r["id"] for r in rare.collect()) == [0, 1, 2] and max(opened(rare)) <= 3
    assert tables.by_key(spark, path, "id", -1, 32).count() == 0 and tables.by_index(spark, path, "how", "never", 32).count() == 0


def test_names_in_four_scripts_are_collated(spark):
    names = ["zoe", "Émile", "emile", "Ávila", "Ярослав", "анна", "Ωμέγα", "άλφα", "王", "Bob"]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r["name"] for r in frame.orderBy(reading.collated(F.col("name"), marks=False), "name").collect()]
    assert got == ["Ávila", "Bob", "emile", "Émile", "zoe", "άλφα", "Ωμέγα", "анна", "Ярослав", "王"]


def test_scores_of_readings(spark):
    got = spark.range(4).select(reading.reading_score(F.lit(0.5), F.col("id") % 2 == 1, F.col("id"))).collect()
    assert [round(r[0], 6) for r in got] == [round(0.3 + 0.4 * (k % 2) + 0.1 * min(k / 3, 1), 6) for k in range(4)] and math.isclose(got[3][0], 0.8)
