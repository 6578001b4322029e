"""Edges of what reviewers are shown and change."""

from pyspark.sql import functions as F

from millrace.functions import review
from millrace.operators import reviews


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_recommendations_need_values(spark):
    nothing = [F.lit(None).cast("string")] * 7
    assert one(spark, review.recommendations(*nothing, "2024-06-01")) == []
    assert one(spark, review.recommendations(*[F.lit("")] * 7, "2024-06-01")) == []


def test_dates_of_birth(spark):
    def codes(birth):
        blank = F.lit("")
        return [r["code"] for r in one(spark, review.recommendations(blank, blank, blank, blank, F.lit(birth), blank, blank, "2024-06-01"))]

    assert codes("1990-12-31") == codes("12/31/1990") == codes("01/02/1990") == []
    assert codes("31/12/1990") == ["DAY_FIRST"]
    assert codes("31/31/1990") == codes("soon") == ["UNREADABLE_DATE"]
    assert codes("1923-01-01") == ["AGE_TOO_HIGH"] and codes("2024-01-01") == ["INFANT"]


def test_bands_are_folded_in_their_order(spark):
    def chosen(bands, height=100):
        rows = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("last"), F.lit(d).alias("density")) for a, b, d in bands])
        got = one(spark, review.choose_band(rows, F.lit(height), 0.5, 0.05, 0.4))
        return got and (got["first"], got["last"])

    assert chosen([(10, 30, 0.9)]) is None
    assert chosen([(60, 62, 0.9), (60, 99, 0.1)]) == (60, 99)
    assert chosen([(60, 70, 0.5), (75, 85, 0.48)]) == (75, 85)
    assert chosen([(75, 85, 0.4), (60, 70, 0.5)]) == (60, 70)
    # 0.44 is about as dense as either other, 0.48 clearly denser than 0.40: the order decides.
    assert chosen([(80, 90, 0.40), (70, 80, 0.44), (60, 70, 0.48)]) == (60, 70)
    assert chosen([(70, 80, 0.44), (60, 70, 0.48), (80, 90, 0.40)]) == (80, 90)


def test_lists_summaries_and_scores(spark):
    none = F.lit(None).cast("array<string>")
    assert one(spark, review.merged_lists(none)) == []
    assert one(spark, review.merged_lists(F.array(F.lit("b"), F.lit("a")), none, F.array(F.lit("a"), F.lit("c")))) == ["b", "a", "c"]
    assert one(spark, review.error_summary(F.lit(None).cast("map<string,array<string>>"))) == ""
    assert one(spark, review.error_summary(F.create_map(F.lit("a"), F.array(F.lit("x"), F.lit("y"))))) == "2 errors in 1 field"
    assert one(spark, review.check_share(F.lit(None).cast("map<string,boolean>"))) == 0
    assert one(spark, review.country_of_lines(F.array(F.lit("P<"), F.lit("P<AB<X")))) is None
    assert one(spark, review.ambiguous_positions(F.lit(""), "date")) == []


def test_edits_of_reviews(spark):
    rows = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, "c", None)], "id int, name string, done boolean")
    fields = F.create_map(F.lit("fullName"), F.col("name"), F.lit("other"), F.lit("o"))
    levels = F.create_map(F.lit("fullName"), F.lit("LOW"), F.lit("other"), F.lit("HIGH"))
    changes = spark.createDataFrame([(1, 1, "fullName", "x"), (1, 2, "fullName", "y"), (1, 3, "other", "z"), (1, 4, "fullName", None), (2, 1, "fullName", "w"), (9, 1, "fullName", "v")], "id int, seq int, field string, value string")
    open_ = reviews.pending(rows, "id", fields, levels, F.col("done"))
    got = {r["id"]: r for r in reviews.confirm(reviews.edited(open_, changes, "id"), "2024-06-01").collect()}
    assert {k: (r["result"], r["has_edits"], r["low"]) for k, r in got.items()} == {
        1: ({"fullName": "y", "other": "o"}, True, ["fullName"]),
        2: ({"fullName": "b", "other": "o"}, False, ["fullName"]),
        3: ({"fullName": "c", "other": "o"}, False, ["fullName"]),
    }
    assert reviews.edited(open_.limit(0), changes, "id").count() == 0
