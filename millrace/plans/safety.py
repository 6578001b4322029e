"""Queries over the accuracy of records, their named checks and the warnings of validated fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import safety
from millrace.functions.safety import KNOWN_COUNTRIES
from millrace.operators import reviews
from millrace.plans.registry import AS_OF, exact, query, spread, table

#: Orders as records: names from customers and orders, dates of two layouts, countries by their beginnings, confidences from prices.
_RECORDS = """r AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1%' THEN c_mktsegment WHEN o_orderpriority LIKE '2%' THEN c_name WHEN o_orderpriority LIKE '3%' THEN initcap_(c_mktsegment) || ' ' || o_orderstatus
        WHEN o_orderpriority LIKE '4%' THEN o_custkey::VARCHAR ELSE o_orderpriority || '#%&' END AS name,
        CASE WHEN o_orderpriority LIKE '5%' THEN strftime(o_orderdate, '%d/%m/%Y') WHEN o_orderstatus = 'P' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS birth,
        CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + INTERVAL 25 YEAR, '%m/%d/%Y') ELSE strftime(o_orderdate + INTERVAL 25 YEAR, '%Y-%m-%d') END AS expiry, o_orderstatus AS gender,
        CASE WHEN o_orderstatus = 'O' THEN n_name ELSE substr(n_name, 1, 2 + n_nationkey % 2) END AS nation, c_mktsegment AS segment,
        CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE (floor(o_totalprice)::BIGINT % 1000) / 1000.0 END::DOUBLE AS own, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (o_custkey % 100) / 100.0 END::DOUBLE AS overall
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)""".replace("initcap_(c_mktsegment)", "substr(c_mktsegment, 1, 1) || lower(substr(c_mktsegment, 2))")
_DATE = "CASE WHEN regexp_full_match({v}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_strptime({v}, '%Y-%m-%d') WHEN regexp_full_match({v}, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN try_strptime({v}, '%m/%d/%Y') END::DATE"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    t = table(spark, sf_dir, "orders").join(customer.drop("c_acctbal"), F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    t = spread(t, "o_orderkey")
    p, status, day = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus"), F.col("o_orderdate")
    title = F.concat(F.substring("c_mktsegment", 1, 1), F.lower(F.expr("substring(c_mktsegment, 2)")), F.lit(" "), status)
    name = F.when(p == "1", F.col("c_mktsegment")).when(p == "2", F.col("c_name")).when(p == "3", title).when(p == "4", F.col("o_custkey").cast("string")).otherwise(F.concat("o_orderpriority", F.lit("#%&")))
    birth = F.when(p == "5", F.date_format(day, "dd/MM/yyyy")).when(status == "P", "").otherwise(F.date_format(day, "yyyy-MM-dd"))
    later = F.add_months(day, 300)
    nation_code = F.when(status == "O", F.col("n_name")).otherwise(F.expr("substring(n_name, 1, 2 + n_nationkey % 2)"))
    return t.select(
        F.col("o_orderkey").alias("id"), name.alias("name"), birth.alias("birth"), F.when(status == "F", F.date_format(later, "MM/dd/yyyy")).otherwise(F.date_format(later, "yyyy-MM-dd")).alias("expiry"),
        status.alias("gender"), nation_code.alias("nation"), F.col("c_mktsegment").alias("segment"),
        F.when(p != "1", F.floor("o_totalprice") % 1000 / 1000).cast("double").alias("own"), F.when(status != "P", F.col("o_custkey") % 100 / 100).cast("double").alias("overall"),
        F.concat(F.lit("Clerk#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("clerk"), F.col("o_orderpriority").alias("priority"), "n_name",
    )


@query(
    "field_accuracies",
    f"""WITH {_RECORDS}, d AS (SELECT *, {_DATE.format(v="birth")} AS b, {_DATE.format(v="expiry")} AS e, length(name) AS n, length(regexp_replace(name, '[^0-9]', '', 'g')) AS dig,
        length(regexp_replace(name, '[a-z]', '', 'g')) AS unlower, length(regexp_replace(name, '[a-zA-Z0-9\\s\\-''.]', '', 'g')) AS odd, {AS_OF[:4]} - year({_DATE.format(v="birth")}) AS age, datediff('day', DATE '{AS_OF}', {_DATE.format(v="expiry")}) AS days FROM r),
    k AS (SELECT *, dig * 2 > n AS mostly, n >= 3 AND NOT regexp_matches(name, '[ .-]') AND regexp_matches(name, '[A-Z]') AND unlower * 10 > n * 7 AS single FROM d),
    a AS (SELECT id, overall, own, 'fullName' AS field, least(CASE WHEN mostly THEN 0.4 WHEN dig * 4 > n THEN 0.7 ELSE 1 END, CASE WHEN n < 2 THEN 0.3 WHEN n = 2 THEN 0.7 ELSE 1 END, CASE WHEN single THEN 0.8 ELSE 1 END, CASE WHEN dig = n THEN 0.1 ELSE 1 END, CASE WHEN odd * 10 > n * 3 THEN 0.5 ELSE 1 END)::DOUBLE AS s,
            [CASE WHEN mostly THEN 'MOSTLY_DIGITS' WHEN dig * 4 > n THEN 'UNUSUAL_DIGITS' END, CASE WHEN n < 2 THEN 'TOO_SHORT' WHEN n = 2 THEN 'VERY_SHORT' END, CASE WHEN single THEN 'GIVEN_NAME_MISSING' END, CASE WHEN dig = n THEN 'ONLY_DIGITS' END, CASE WHEN odd * 10 > n * 3 THEN 'UNUSUAL_CHARACTERS' END] AS i FROM k
        UNION ALL SELECT id, overall, NULL, 'dateOfBirth', CASE WHEN b IS NULL THEN 0.5 WHEN age <= 0 OR age >= 120 THEN 0.2 WHEN age < 5 THEN 0.7 WHEN age > 90 THEN 0.8 ELSE 1 END, CASE WHEN b IS NULL THEN ['INVALID_DATE', 'AMBIGUOUS_ORDER'] WHEN age <= 0 OR age >= 120 THEN ['AGE_OUT_OF_RANGE'] WHEN age < 5 THEN ['VERY_YOUNG'] ELSE [] END FROM k WHERE birth <> ''
        UNION ALL SELECT id, overall, own, 'passportExpiryDate', CASE WHEN days < 0 THEN 0.3 WHEN days < 90 THEN 0.7 ELSE 1 END, CASE WHEN days < 0 THEN ['EXPIRED'] WHEN days < 90 THEN ['NEAR_EXPIRY'] ELSE [] END FROM k
        UNION ALL SELECT id, overall, NULL, 'gender', CASE WHEN gender IN ('M', 'F') THEN 1 ELSE 0.5 END, CASE WHEN gender IN ('M', 'F') THEN [] ELSE ['UNUSUAL_GENDER'] END FROM k
        UNION ALL SELECT id, overall, NULL, 'nationality', CASE WHEN NOT regexp_full_match(nation, '[A-Za-z]{{2,3}}') THEN 0.4 WHEN length(nation) = 2 AND upper(nation) NOT IN ('{"','".join(KNOWN_COUNTRIES)}') THEN 0.7 ELSE 1 END,
            CASE WHEN NOT regexp_full_match(nation, '[A-Za-z]{{2,3}}') THEN ['UNEXPECTED_FORMAT'] WHEN length(nation) = 2 AND upper(nation) NOT IN ('{"','".join(KNOWN_COUNTRIES)}') THEN ['UNRECOGNISED_COUNTRY'] ELSE [] END FROM k),
    m AS (SELECT id, field, CASE WHEN own IS NOT NULL THEN s + (own - s) * CASE WHEN own >= 0.9 THEN 0.3 WHEN own >= 0.7 THEN 0.4 ELSE 0.5 END WHEN overall < 0.9 THEN s * 0.7 + overall * 0.3 ELSE s END AS s,
        list_concat(i, [CASE WHEN own < 0.9 THEN 'OCR_CONFIDENCE' END, CASE WHEN own < 0.7 THEN 'LOW_OCR_CONFIDENCE' END, CASE WHEN own IS NULL AND overall < 0.7 THEN 'LOW_OVERALL_CONFIDENCE' END]) AS i FROM a)
    SELECT id, field, CASE WHEN round(s, 9) >= 0.9 THEN 'HIGH' WHEN round(s, 9) >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS level, round(s, 6)::DOUBLE AS score, coalesce(array_to_string(list_filter(i, lambda x: x IS NOT NULL), ';'), '') AS issues FROM m""",
)
def field_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each filled field of each order read as a record; the name and the expiry have a confidence of their own."""
    t = _records(spark, sf_dir)
    record = {"fullName": F.col("name"), "dateOfBirth": F.col("birth"), "passportExpiryDate": F.col("expiry"), "gender": F.col("gender"), "nationality": F.col("nation")}
    own = F.when(F.col("own").isNotNull(), F.create_map(F.lit("fullName"), F.col("own"), F.lit("passportExpiryDate"), F.col("own")))
    rows = reviews.field_accuracies(t, ["id"], record, own, F.col("overall"), AS_OF)
    score = F.round("score", 9)
    return rows.select("id", "field", F.when(score >= 0.9, "HIGH").when(score >= 0.7, "MEDIUM").otherwise("LOW").alias("level"), exact(F.col("score")).alias("score"), F.array_join("issues", ";").alias("issues"))


@query(
    "safety_checks",
    f"""WITH {_RECORDS}, d AS (SELECT *, {_DATE.format(v="birth")} AS b, {_DATE.format(v="expiry")} AS e, length(name) AS n, length(regexp_replace(name, '[^0-9]', '', 'g')) AS dig, substr(nation, 1, 2) AS issuer FROM r),
    k AS (SELECT *, {AS_OF[:4]} - year(b) AS age FROM d)
    SELECT id, concat_ws(';', CASE WHEN n = 1 THEN 'field_fullName_length' END, CASE WHEN dig = n THEN 'field_fullName_digits' END, CASE WHEN dig * 2 > n THEN 'field_fullName_digitRatio' END,
        CASE WHEN NOT regexp_full_match(segment, '[A-Za-z0-9]{{5,20}}') THEN 'field_passportNumber_format' END, CASE WHEN NOT regexp_full_match(name, '[A-Za-z0-9]{{5,30}}') THEN 'field_idNumber_format' END,
        CASE WHEN birth <> '' AND b IS NULL THEN 'field_dateOfBirth_parse' END, CASE WHEN age < 1 OR age > 119 THEN 'field_dateOfBirth_range' END, CASE WHEN e < DATE '{AS_OF}' THEN 'field_passportExpiryDate_expired' END,
        CASE WHEN gender NOT IN ('M', 'F') THEN 'field_gender_value' END, CASE WHEN gender <> 'M' THEN 'field_gender_name_consistency' END, CASE WHEN e <= b THEN 'field_expiry_vs_dob' END) AS failed,
        2 + (birth <> '')::INT + (b IS NOT NULL)::INT + 1 + (n = 1)::INT + (dig = n)::INT + (dig * 2 > n)::INT + coalesce(e < DATE '{AS_OF}', FALSE)::INT + (gender <> 'M')::INT + coalesce(e <= b, FALSE)::INT AS n_checks,
        concat_ws(';', CASE WHEN segment = 'FURNITURE' AND gender <> 'F' THEN 'guest_not_failed' END, CASE WHEN birth = '' THEN 'required_fields_exist' END) AS row_failed,
        concat_ws(';', CASE WHEN coalesce(overall, 0) < 0.9 THEN 'high_confidence' END, CASE WHEN coalesce(overall, 0) < 0.7 THEN 'medium_confidence' END) AS confidence_failed FROM k""",
)
def safety_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as records: the segment as a passport's number, the name as a card's, all names taken for men's."""
    t = _records(spark, sf_dir)
    record = {"fullName": F.col("name"), "passportNumber": F.col("segment"), "idNumber": F.col("name"), "dateOfBirth": F.col("birth"), "passportExpiryDate": F.col("expiry"), "gender": F.col("gender"), "likelyGender": F.lit("M")}
    c = safety.field_checks(record, AS_OF)
    row = safety.row_checks(F.col("id").cast("string"), F.when(F.col("segment") == "FURNITURE", "FAILED"), F.lit("PASSPORT"), F.col("name"), F.col("birth"), F.lit(None).cast("string"), F.col("gender") == "F")
    surely = safety.confidence_checks(F.col("overall"))
    return t.select("id", F.array_join(c["failed"], ";").alias("failed"), F.size(c["checks"]).alias("n_checks"), F.array_join(row["failed"], ";").alias("row_failed"), F.array_join(surely["failed"], ";").alias("confidence_failed"))


@query(
    "validation_warnings",
    """WITH w AS (SELECT DISTINCT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 'PASSPORT_NUMBER_REPAIRED' WHEN l_returnflag = 'R' THEN 'COUNTRY_CODE_REPAIRED' WHEN l_linestatus = 'O' THEN 'LOW_CONFIDENCE_FIELD' END AS warning FROM lineitem)
    SELECT l_orderkey, coalesce(string_agg(warning, ';' ORDER BY warning), '') AS warnings FROM w GROUP BY l_orderkey""",
)
def validation_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as its validated fields."""
    flag = F.col("l_returnflag")
    code = F.when(flag == "A", "AMBIGUOUS_CHARS").when(flag == "R", "COUNTRY_CODE_REPAIRED").otherwise("TOO_LONG")
    result = F.struct(F.array(code).alias("codes"), (F.col("l_linestatus") == "O").alias("needs_review"))
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(result).alias("results"))
    return t.select("l_orderkey", F.array_join(F.array_sort(safety.validation_warnings(F.col("results"))), ";").alias("warnings"))
