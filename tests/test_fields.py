"""Edges of fields in long form: validation in both dialects, readiness, quick fixes, advice across fields."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import fields
from millrace.operators import reviews

AS_OF = "2024-06-01"


def one(spark, column):
    return spark.range(1).select(F.struct(column.alias("v")).alias("s")).first()["s"]["v"]


def check(spark, field, value, confidence=0.8, **options):
    limits = options.get("limits", fields.Limits())
    v = fields.validated(F.lit(field), F.lit(value).cast("string"), F.lit(confidence), AS_OF, **options)
    row = spark.range(1).select(v.alias("v")).select("v", *[c.alias(n) for n, c in zip(("valid", "review"), fields.judged(F.col("v"), limits), strict=True)]).first()
    return row["v"], row["valid"], row["review"]


SERVICE = [
    ("surname", "Ng ##", "Ng", ["TRAILING_OCR_NOISE"]), ("surname", "a#b#", "a#b#", ["INVALID_FORMAT"]), ("surname", "###", "#", ["INVALID_FORMAT", "TRAILING_OCR_NOISE"]), ("surname", "  ", "", ["FIELD_EMPTY"]), ("surname", None, "", ["FIELD_EMPTY"]),
    ("surname", "#" * 50_000, "#", ["INVALID_FORMAT", "TRAILING_OCR_NOISE", "TOO_LONG"]), ("lastName", "Đỗ", "Đ", ["TRAILING_OCR_NOISE"]), ("firstName", "Đoàn", "Đoàn", []),
    ("passportNumber", " ab<1 ", "AB1", ["INVALID_FORMAT", "PASSPORT_NORMALIZED", "TOO_SHORT"]), ("documentNumber", "X1O45", "X1O45", ["AMBIGUOUS_CHARS"]), ("passportNumber", "  ", "  ", ["FIELD_EMPTY", "PASSPORT_NORMALIZED"]), ("passportNumber", "<<<", "<<<", ["INVALID_FORMAT", "PASSPORT_NORMALIZED"]),
    ("nationality", "vnm", "VNM", []), ("nationality", "VN1", "VNM", ["COUNTRY_CODE_REPAIRED"]), ("countryCode", "ZZZ", "ZZZ", ["UNRECOGNIZED_COUNTRY"]), ("issuingCountry", "VN", "VN", ["INVALID_LENGTH"]), ("nationality", "D<<", "D<<", ["INVALID_LENGTH"]),
    ("dateOfBirth", "1899-12-31", "1899-12-31", ["UNUSUALLY_OLD", "UNUSUAL_AGE"]), ("dateOfBirth", "2024-06-02", "2024-06-02", ["FUTURE_DATE", "UNUSUAL_AGE"]), ("dateOfBirth", AS_OF, AS_OF, []), ("dateOfBirth", "2023-02-29", "2023-02-29", ["INVALID_DATE"]),
    ("expiryDate", "2024-05-31", "2024-05-31", ["EXPIRED"]), ("expiryDate", AS_OF, AS_OF, ["EXPIRING_SOON"]), ("expiryDate", "2024-09-01", "2024-09-01", []), ("idExpiryDate", "2100-01-02", "2100-01-02", ["UNUSUAL_EXPIRY"]),
    ("gender", "X", "X", []), ("gender", "m", "m", ["INVALID_GENDER"]), ("documentType", "VISA", "VISA", ["UNSUPPORTED_TYPE"]), ("idNumber", "#", "#", []),
]


def all_of(spark, cases, dialect):
    frame = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, field string, value string")
    v = frame.select("i", fields.validated(F.col("field"), F.col("value"), F.lit(0.8), AS_OF, dialect=dialect).alias("v"))
    valid, review = fields.judged(F.col("v"))
    return sorted(v.select("i", "v", valid.alias("valid"), review.alias("review")).collect())


def test_service_rules(spark):
    for (_, v, valid, review), (field, value, clean, issues) in zip(all_of(spark, SERVICE, "service"), SERVICE, strict=True):
        assert (v["field"], v["value"], v["issues"]) == (field, clean, issues), value
        bad = bool(set(issues) & set(fields.ERRORS))
        assert (valid, review) == (not bad, bad or round(v["adjusted"], 9) < 0.7)


def test_confidences(spark):
    def adjusted(*args, **options):
        return round(check(spark, *args, **options)[0]["adjusted"], 9)

    yes = F.lit(True)
    assert adjusted("surname", "Ng", 0.8, corrected=yes) == 0.7 and adjusted("surname", "Ng", 0.05, corrected=yes) == 0.0
    assert adjusted("surname", "Ng", 0.9, digits_passed=yes, zone_valid=yes) == 1.0 and adjusted("surname", "Ng", 0.8, zone_valid=yes) == 0.875
    assert adjusted("nationality", "VN1", 0.8, digits_passed=yes) == 0.85 and adjusted("nationality", "VN1", 0.8, limits=fields.Limits(repair=False)) == 0.8
    assert adjusted("surname", "Ng", 0.8, digits_passed=yes, limits=fields.Limits(boosted=False)) == 0.8 and adjusted("idNumber", "1", 0.8, corrected=yes, digits_passed=yes) == 0.8
    assert adjusted("surname", "Ng", 0.95, zone_valid=yes, corrected=yes, dialect="util") == 0.9 and adjusted("documentType", "1", 0.8, zone_valid=yes, dialect="util") == 0.8
    assert check(spark, "surname", "Ng", 0.39)[1:] == (False, True) and check(spark, "idNumber", "", 0.1)[1:] == (False, False)


OLDER = [
    ("surname", "Ng #", ["INVALID_FORMAT"]), ("surname", "Đoàn", ["INVALID_FORMAT"]), ("passportNumber", "AB<123", []), ("passportNumber", "ab123", ["INVALID_FORMAT"]), ("nationality", "vnm", []), ("nationality", "XXX", ["UNRECOGNIZED_COUNTRY"]),
    ("nationality", "VN1", ["UNRECOGNIZED_COUNTRY"]), ("dateOfBirth", "1903-12-31", ["UNUSUAL_AGE"]), ("dateOfBirth", "1904-01-01", []), ("gender", "X", ["INVALID_GENDER"]), ("documentType", "VISA", []), ("lastName", "#", []),
]


def test_older_rules(spark):
    for (_, v, *_), (field, value, issues) in zip(all_of(spark, OLDER, "util"), OLDER, strict=True):
        assert (v["field"], v["value"], v["issues"], v["repaired_from"]) == ("fullName" if field == "surname" else field, value, issues, None)


def test_rows_and_readiness(spark):
    whole = ("Anna Ng", "C1234567", "1990-01-02", "2030-01-01", "VNM", "F")
    frame = spark.createDataFrame([(1, *whole, "s"), (2, *whole[:5], "", "s"), (3, "Anna Ng", None, "x", *whole[3:], "s"), (4, *[None] * 6, "s")], "id int, n string, p string, b string, e string, c string, g string, field string")
    record = {"fullName": F.col("n"), "passportNumber": F.col("p"), "dateOfBirth": F.col("b"), "expiryDate": F.col("e"), "nationality": F.col("c"), "gender": F.col("g")}
    rows = reviews.validated_fields(frame, ["id"], record, AS_OF)
    assert rows.count() == 6 + 5 + 5 and {"PASSPORT"}.isdisjoint({r["field"] for r in rows.collect()})
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: (r["n_fields"], r["to_review"], r["ready"]) for r in reviews.document_readiness(rows, "id").collect()}
    assert got == {1: (6, [], True), 2: (5, [], False), 3: (5, ["dateOfBirth"], False)}
    assert reviews.document_readiness(rows.where("false"), "id").count() == 0


def test_readiness_of_known_names(spark):
    schema = "id int, field string, adjusted double, valid boolean, needs_review boolean"
    rows = spark.createDataFrame([(k, n, 0.5 + k / 10, j % 3 > 0, (j + k) % 2 == 0) for k in range(4) for j, n in enumerate([*reviews.NEEDED[: 3 + k], "surname", "fullName", "fullName"])] + [(9, n, 0.9, True, False) for n in reviews.NEEDED], schema)
    known = reviews.document_readiness(rows, "id", names=fields.DOCUMENT_FIELDS["service"])
    assert sorted(known.collect()) == sorted(reviews.document_readiness(rows, "id").collect())
    assert {r["id"]: r["to_review"].count("fullName") for r in known.collect()}[3] == 1 and {r["id"] for r in known.where("ready").collect()} == {9}
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    with pytest.raises(Exception, match="not among the names: surname"):
        reviews.document_readiness(rows, "id", names=reviews.NEEDED).collect()


def test_fixes(spark):
    def fixes(field, value, nation=None, most=5):
        return [tuple(f) for f in one(spark, fields.quick_fixes(F.lit(field), F.lit(value).cast("string"), F.lit(nation).cast("string"), AS_OF, most))]

    assert fixes("passportNumber", None) == fixes("passportNumber", "") == fixes("surname", "Ann") == fixes("other", "0") == fixes("nationality", "ZZ") == fixes("gender", "X") == fixes("dateOfBirth", "1990-01-02") == []
    assert fixes("passportNumber", "A1234567", "vn")[0] == ("replace", "AMBIGUOUS_CHARACTER", "AI234567") and len(fixes("passportNumber", "A1234567", "VN", 50)) == 6
    assert fixes("passportNumber", "000", "VNM")[:3] == [("review", "PLACEHOLDER_NUMBER", None), ("review", "COUNTRY_FORMAT", None), ("replace", "AMBIGUOUS_CHARACTER", "O00")]
    assert fixes("idNumber", "77B") == [("replace", "AMBIGUOUS_CHARACTER", "778")] and len(fixes("idNumber", "0" * 2_000)) == 5
    assert fixes("fullName", "4") == [("review", "NAME_TOO_SHORT", None), ("replace", "DIGITS_IN_NAME", "")] and fixes("surname", "Li") == [("review", "NAME_MAY_BE_CUT", None)]
    assert fixes("dateOfBirth", "19900203") == [("replace", "COMPACT_DATE", "03/02/1990")] and fixes("dateOfBirth", "31/12/1990") == [("replace", "DAY_FIRST", "1990-12-31")] and fixes("dateOfBirth", "1890-01-01") == [("review", "AGE_OUT_OF_RANGE", None)]
    assert fixes("gender", "male") == [("replace", "SEX_IN_WORDS", "M")] and fixes("nationality", "vn") == [("replace", "TWO_LETTER_COUNTRY", "VNM")]


def test_advice(spark):
    def advice(**record):
        full = {"dateOfBirth": None, "passportExpiryDate": None} | record
        return [(a["field"], a["code"]) for a in one(spark, fields.further_advice({k: F.lit(v).cast("string") for k, v in full.items()}, AS_OF))]

    assert advice() == advice(nationality="VN", issuingCountry="VNM", fullName="ÁNH Lê", surname="anh", givenName="x", passportNumber="C1234567") == []
    assert advice(fullName="A", surname="B", givenName="C", gender="F", likelyGender="M") == [("cross-field", "NAME_MISMATCH"), ("gender", "GENDER_MISMATCH")]
    assert advice(dateOfBirth="2000-01-01", passportExpiryDate="2000-01-01") == [("dateOfBirth", "EXPIRY_BEFORE_BIRTH"), ("dateOfBirth", "IMPLAUSIBLE_VALIDITY")]
    assert advice(dateOfBirth="1900-01-01", passportExpiryDate="01/02/2024") == [("passportNumber", "AGE_AT_EXPIRY"), ("dateOfBirth", "IMPLAUSIBLE_VALIDITY")]
