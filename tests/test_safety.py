"""Edges of the accuracy of fields, of named checks and of warnings."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import safety
from millrace.operators import reviews

AS_OF = "2024-06-01"


def one(spark, column):
    return spark.range(1).select(F.struct(column).alias("v")).first()["v"][0]


@pytest.mark.parametrize(
    "name,score,issues",
    [
        ("Anna Maria", 1.0, []), ("", 0.3, ["TOO_SHORT"]), (None, 0.3, ["TOO_SHORT"]), ("Li", 0.7, ["VERY_SHORT"]), ("NGUYỄN", 0.8, ["GIVEN_NAME_MISSING"]), ("Nguyen", 1.0, []),
        ("1234", 0.1, ["MOSTLY_DIGITS", "ONLY_DIGITS"]), ("An1a", 1.0, []), ("An12 b", 0.7, ["UNUSUAL_DIGITS"]), ("a#%&", 0.5, ["UNUSUAL_CHARACTERS"]), ("A" * 50_000, 0.8, ["GIVEN_NAME_MISSING"]),
    ],
)
def test_names(spark, name, score, issues):
    a = one(spark, safety.name_accuracy(F.lit(name).cast("string")))
    assert (a["score"], a["issues"]) == (score, issues)


@pytest.mark.parametrize(
    "kind,date,score,issues",
    [
        ("birth", "1990-02-03", 1.0, []), ("birth", "02/13/1990", 1.0, []), ("birth", "13/02/1990", 0.5, ["INVALID_DATE", "AMBIGUOUS_ORDER"]), ("birth", "99/99/1990", 0.2, ["INVALID_DATE"]), ("birth", None, 0.2, ["INVALID_DATE"]),
        ("birth", "2024-01-01", 0.2, ["AGE_OUT_OF_RANGE"]), ("birth", "2021-01-01", 0.7, ["VERY_YOUNG"]), ("birth", "1930-01-01", 0.8, []), ("birth", "1904-12-31", 0.2, ["AGE_OUT_OF_RANGE"]), ("birth", "99/99/99999999999", 0.2, ["INVALID_DATE"]),
        ("expiry", "2024-05-31", 0.3, ["EXPIRED"]), ("expiry", AS_OF, 0.7, ["NEAR_EXPIRY"]), ("expiry", "2024-08-29", 0.7, ["NEAR_EXPIRY"]), ("expiry", "2024-08-30", 1.0, []),
    ],
)
def test_dates(spark, kind, date, score, issues):
    a = one(spark, safety.date_accuracy(F.lit(date).cast("string"), kind, AS_OF))
    assert (a["score"], a["issues"]) == (score, issues)


def test_blending(spark):
    sure = safety.gender_accuracy(F.lit("F"))

    def blend(own, overall):
        b = one(spark, safety.blended(sure, F.lit(own).cast("double"), F.lit(overall).cast("double")))
        return round(b["score"], 9), b["level"], b["issues"]

    assert blend(None, None) == (1.0, "HIGH", []) and blend(None, 0.95) == (1.0, "HIGH", [])
    assert blend(None, 0.5) == (0.85, "MEDIUM", ["LOW_OVERALL_CONFIDENCE"]) and blend(None, 0.8) == (0.94, "HIGH", [])
    assert blend(0.9, 0.1) == (0.97, "HIGH", []) and blend(0.7, None) == (0.88, "MEDIUM", ["OCR_CONFIDENCE"]) and blend(0.2, None) == (0.6, "LOW", ["OCR_CONFIDENCE", "LOW_OCR_CONFIDENCE"])


def test_rows_of_filled_fields(spark):
    frame = spark.createDataFrame([(1, "UNKNOWN", "", "xx", "A-1", 0.5, "s"), (2, None, None, None, None, None, None), (3, None, "Ng", None, None, None, "s")], "id int, gender string, surname string, nation string, card string, overall double, score string")
    record = {"gender": F.col("gender"), "surname": F.col("surname"), "nationality": F.col("nation"), "issuingCountry": F.lower("nation"), "idNumber": F.col("card")}
    own = F.create_map(F.lit("gender"), F.lit(None).cast("double"), F.lit("surname"), F.lit(0.9))
    got = reviews.field_accuracies(frame, ["id"], record, own, F.col("overall"), AS_OF)
    assert got.columns == ["id", "field", "level", "score", "issues"]
    low = "LOW_OVERALL_CONFIDENCE"
    assert sorted((r["id"], r["field"], round(r["score"], 9), r["issues"]) for r in got.collect()) == [
        (1, "gender", 0.15, ["UNUSUAL_GENDER", low]), (1, "idNumber", 0.36, ["AMBIGUOUS_CHARS", "INVALID_FORMAT", low]), (1, "issuingCountry", 0.64, ["UNRECOGNISED_COUNTRY", low]), (1, "nationality", 0.64, ["UNRECOGNISED_COUNTRY", low]),
        (3, "surname", 0.76, ["VERY_SHORT"]),
    ]
    none = reviews.field_accuracies(frame.where("false"), ["id"], record, F.lit(None).cast("map<string,double>"), F.col("overall"), AS_OF)
    assert none.count() == 0 and "Exchange" not in none._jdf.queryExecution().executedPlan().toString()


def test_field_checks(spark):
    def failed(**record):
        c = one(spark, safety.field_checks({k: F.lit(v) for k, v in record.items()}, AS_OF))
        assert c["passed"] == (not c["failed"]) and set(c["failed"]) <= {x["name"] for x in c["checks"]}
        return [n.removeprefix("field_") for n in c["failed"]], len(c["checks"])

    assert failed() == ([], 0)
    assert failed(fullName="7", gender="UNKNOWN") == (["fullName_length", "fullName_digits", "fullName_digitRatio"], 3)
    assert failed(passportNumber="000000000", nationality="GB", issuingCountry="GBR") == (["passportNumber_zeros"], 2)
    assert failed(passportNumber="12345678", nationality="GBR", issuingCountry="FR") == (["passportNumber_countryPattern", "nationality_consistency"], 3)
    assert failed(dateOfBirth="2030-01-01", passportExpiryDate="2029-01-01") == (["dateOfBirth_range", "dateOfBirth_future", "expiry_vs_dob"], 4)
    assert failed(fullName="Anna", gender="M", likelyGender="F", idExpiryDate="2020-01-01", dateOfBirth="x") == (["dateOfBirth_parse", "idExpiryDate_expired", "gender_name_consistency"], 4)


def test_row_and_template_checks(spark):
    text = lambda v: F.lit(v).cast("string")
    row = one(spark, safety.row_checks(text(None), text("FAILED"), text("ID_CARD"), text("n"), text("p"), text(""), F.lit(None).cast("boolean")))
    assert row["failed"] == ["guest_row_exists", "guest_not_failed", "required_fields_exist"]
    assert one(spark, safety.row_checks(text("1"), text("FAILED"), text("PASSPORT"), text("n"), text("p"), text(None), F.lit(True)))["passed"]
    assert one(spark, safety.confidence_checks(F.lit(0.7)))["failed"] == ["high_confidence"]
    assert one(spark, safety.auto_save_checks(text("auto"), text(""), text("x"), F.array(text("a"), text(None)), text("READY")))["failed"] == ["required_values_exist"]
    mappings = F.array(*[F.struct(text(s).alias("source"), F.lit(e).alias("enabled")) for s, e in (("a", True), ("b", False), ("c", True))])
    assert [tuple(r) for r in one(spark, safety.mapped_value_checks(F.create_map(F.lit("a"), F.lit("1")), mappings))] == [("field_a", True), ("field_c", False)]


def test_warnings_in_order_and_once(spark):
    rows = [(["X", "TRAILING_OCR_NOISE", "AMBIGUOUS_CHARS"], True), (None, True), ([], False), (["COUNTRY_CODE_REPAIRED"], None)]
    frame = spark.createDataFrame([(rows,), (None,), ([],)], "r array<struct<codes:array<string>,needs_review:boolean>>")
    got = [r[0] for r in frame.select(safety.validation_warnings(F.col("r"))).collect()]
    assert got == [["LOW_CONFIDENCE_FIELD", "PASSPORT_NUMBER_REPAIRED", "COUNTRY_CODE_REPAIRED"], [], []]
