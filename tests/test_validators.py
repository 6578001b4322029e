"""Field validators on stated vectors."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import validators as val


@pytest.fixture
def one(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return value


@pytest.mark.parametrize("v,out", [("VNB", "VNM"), ("vnm", "VNM"), ("VNAA", "VNM"), ("D0U", "DEU"), ("FR1", "FRA"), ("FRA", "FRA"), ("ZZ9", None), ("Q", None), ("ABCDE", None), ("", None), (None, None)])
def test_country_repair(one, v, out):
    assert one(val.repair_country(F.lit(v).cast("string"))) == out


def test_names(one):
    def check(v):
        r = one(val.validate_field("name", F.lit(v), F.lit(0.9), "2024-06-01"))
        return r["value"], r["issues"], r["valid"]

    assert check("NGUYEN VAN A") == ("NGUYEN VAN A", [], True)
    assert check("NGUYEN VAN A<<1") == ("NGUYEN VAN A", ["TRAILING_OCR_NOISE"], True)
    assert check("") == ("", ["FIELD_EMPTY"], False)
    assert check("A1B")[1] == ["INVALID_FORMAT"]


def test_confidence_moves(one):
    def confidence(**flags):
        return round(one(val.validate_field("gender", F.lit("M"), F.lit(0.6), "2024-06-01", **{k: F.lit(x) for k, x in flags.items()}))["confidence"], 3)

    assert [confidence(), confidence(corrected=True), confidence(digits_passed=True), confidence(zone_valid=True), confidence(corrected=True, digits_passed=True, zone_valid=True)] == [0.6, 0.5, 0.75, 0.675, 0.65]


def test_gates(one):
    assert one(val.check_list({"a": F.lit(True), "b": F.lit(None).cast("boolean")}))["failed"] == ["b"]
    assert one(val.glob_match("https://*.example.com/a?b", F.lit("x https://pms.example.com/a?b y"))) is True
    assert one(val.glob_match("https://*.example.com/a?b", F.lit("https://pms.exampleXcom/ab"))) is False
    assert one(val.import_status(F.lit("need review"), F.lit("PASSPORT"), F.lit(""), F.lit(""))) == "NEED_REVIEW"
    assert one(val.merged_options(F.create_map(F.lit("a"), F.lit("1"), F.lit("z"), F.lit("2")), {"a": "0", "b": "9"})) == {"a": "1", "b": "9"}
