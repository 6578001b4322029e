"""Edges of recognisers' results as records."""

from pyspark.sql import functions as F

from millrace.functions import results

FIELDS = "map<string,struct<value:string,confidence:double>>"


def test_guest_records(spark):
    rows = [
        (1, {"fullName": ("Ann", 0.9), "expiryDate": ("2030-01-01", 0.5), "surname": ("x", None), "gender": None}, "PASSPORT", "F", "HIGH", []),
        (2, {"expiryDate": ("2030-01-01", 0.5)}, "ID_CARD", None, "HIGH", ["MISSING_REQUIRED_FIELD", "DOCUMENT_EXPIRED"]),
        (3, {"expiryDate": ("2030-01-01", 0.5)}, None, "", "LOW", None), (4, None, None, None, None, None), (5, {"fullName": ("", 0.1), "idNumber": None}, "VISA", "X", "HIGH", ["DOCUMENT_EXPIRED"]),
        (6, {"idNumber": ("7", 0.1), "expiryDate": ("", 0.1)}, "UNKNOWN", "X", "MEDIUM", ["MISSING_REQUIRED_FIELD"]),
    ]
    frame = spark.createDataFrame(rows, f"id int, fields {FIELDS}, document string, gender string, level string, warnings array<string>")
    g = results.guest_record(F.col("fields"), F.col("document"), F.col("gender"), F.lit(0.5), F.col("level"), F.col("warnings"))
    got = {r["id"]: r["g"] for r in frame.select("id", g.alias("g")).collect()}
    assert [got[i]["status"] for i in range(1, 7)] == ["READY", "NEED_REVIEW", "NEED_REVIEW", "FAILED", "FAILED", "MISSING_DATA"]
    assert [(got[i]["passportExpiryDate"], got[i]["idExpiryDate"]) for i in (1, 2, 3, 6)] == [("2030-01-01", None), (None, "2030-01-01"), ("2030-01-01", None), (None, None)]
    assert got[1]["fieldConfidence"] == {"fullName": 0.9, "expiryDate": 0.5, "surname": None} and got[4]["fieldConfidence"] == {} and got[5]["fieldConfidence"] == {"fullName": 0.1}
    assert [got[i]["ocrWarning"] for i in (1, 2, 3)] == [None, "MISSING_REQUIRED_FIELD; DOCUMENT_EXPIRED", None] and got[4]["fullName"] == "" and got[1]["surname"] is None
    assert [got[i]["gender"] for i in (1, 2, 3)] == ["F", "UNKNOWN", "UNKNOWN"] and [got[i]["documentType"] for i in (3, 5)] == ["UNKNOWN", "VISA"]


def test_merged_checks(spark):
    v = {n: F.lit(n == "overall") for n in results.CHECKS} | {"composite": F.lit(None).cast("boolean")}
    theirs = spark.createDataFrame([({"overall_valid": False, "extra": True},), ({"overall_valid": None},), (None,)], "m map<string,boolean>")
    a, b, c = (r[0] for r in theirs.select(results.merged_checks(v, F.col("m"))).collect())
    assert a["overall_valid"] is False and a["extra"] is True and len(a) == 7 and b["overall_valid"] is True and c == b and c["final_composite_valid"] is False
