"""Queries over field validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import validators as val
from millrace.plans.registry import AS_OF, exact, query, table

_KNOWN = "'" + "','".join(val.COUNTRY_CODES) + "'"
_REPAIR = f"""CASE WHEN length(c) NOT BETWEEN 2 AND 4 THEN NULL WHEN c IN ({_KNOWN}) THEN c WHEN c IN ('VNB', 'VNA', 'VNAA', 'VNMA', 'VNN') THEN 'VNM' {" ".join(f"WHEN length(c) = 3 AND starts_with(c, '{a}') THEN '{b}'" for a, b in val.COUNTRY_BEGINNINGS.items())} END"""
_RAW = "['vnm', 'VNAA', 'D0U', 'Q', 'ZZ9', ' us.a', 'FRX', 'XOM'][(o_orderkey % 8 + 1)::INT]"


@query(
    "country_repair",
    f"""WITH r AS (SELECT o_orderkey, {_RAW} AS raw, ['FRA', 'bad'][(o_orderkey % 2 + 1)::INT] AS issuing FROM orders), c AS (SELECT *, regexp_replace(upper(trim(raw)), '[^A-Z0-9]', '', 'g') AS c FROM r)
    SELECT raw, issuing, {_REPAIR} AS repaired, coalesce({_REPAIR}, CASE WHEN upper(issuing) IN ({_KNOWN}) THEN upper(issuing) END, raw) AS nationality, count(*) AS n FROM c GROUP BY ALL""",
)
def country_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.element_at(F.array(*map(F.lit, ["vnm", "VNAA", "D0U", "Q", "ZZ9", " us.a", "FRX", "XOM"])), (k % 8 + 1).cast("int"))
    issuing = F.element_at(F.array(F.lit("FRA"), F.lit("bad")), (k % 2 + 1).cast("int"))
    r = table(spark, sf_dir, "orders").select(raw.alias("raw"), issuing.alias("issuing"))
    return r.groupBy("raw", "issuing", val.repair_country(F.col("raw")).alias("repaired"), val.repair_nationality(F.col("raw"), F.col("issuing")).alias("nationality")).agg(F.count("*").alias("n"))


@query(
    "validate_dates",
    f"""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN '2020-02-30' WHEN 2 THEN strftime(o_orderdate + INTERVAL 27 YEAR, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS v, o_orderkey % 6 AS k, o_orderdate::DATE AS d, (o_orderdate + INTERVAL 27 YEAR)::DATE AS later, (o_orderkey % 10) / 10.0 AS c, o_custkey % 2 = 0 AS corrected, o_custkey % 3 = 0 AS digits, o_custkey % 5 = 0 AS zone FROM orders),
    x AS (SELECT *, CASE WHEN k = 0 THEN 'FIELD_EMPTY' WHEN k = 1 THEN 'INVALID_DATE' WHEN k = 2 AND later > DATE '{AS_OF}' THEN 'FUTURE_DATE' ELSE '' END AS errors,
          CASE WHEN corrected THEN greatest(0, c - 0.1) ELSE c END AS base FROM r),
    y AS (SELECT *, CASE WHEN k = 2 AND later > DATE '{AS_OF}' AND date_sub('month', DATE '{AS_OF}', later) >= 0 AND later > DATE '{AS_OF}' THEN true ELSE false END AS future, CASE WHEN digits THEN least(1, base + 0.15) WHEN zone THEN least(1, base + 0.075) ELSE base END AS conf FROM x)
    SELECT o_orderkey, CASE WHEN future THEN 'FUTURE_DATE;UNUSUAL_AGE' ELSE errors END AS issues, round(conf, 6) AS confidence, errors = '' AND round(conf, 9) >= 0.4 AS valid FROM y""",
)
def validate_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    later = F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 324), "yyyy-MM-dd")
    v = F.when(k % 6 == 0, "").when(k % 6 == 1, "2020-02-30").when(k % 6 == 2, later).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    r = val.validate_field("birth", v, k % 10 / 10, AS_OF, c % 2 == 0, c % 3 == 0, c % 5 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(r["issues"], ";").alias("issues"), exact(r["confidence"]).alias("confidence"), ((F.size(r["issues"]) == 0) & (F.round(r["confidence"], 9) >= 0.4)).alias("valid"))


@query(
    "validate_numbers",
    """WITH r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'ab' || c_custkey || '<<<' WHEN 2 THEN 'A!' ELSE 'PO' || lpad(c_custkey::VARCHAR, 6, '0') END AS v FROM customer), c AS (SELECT *, replace(upper(trim(v)), '<', '') AS u FROM r)
    SELECT c_custkey, u AS value, concat_ws(';', CASE WHEN v = '' THEN 'FIELD_EMPTY' WHEN NOT regexp_matches(u, '^[A-Z0-9]{5,20}$') THEN 'INVALID_FORMAT' END, CASE WHEN v <> '' AND u <> v THEN 'PASSPORT_NORMALIZED' END, CASE WHEN regexp_matches(u, '[OIL]') THEN 'AMBIGUOUS_CHARS' END) AS issues FROM c""",
)
def validate_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    v = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("ab"), s, F.lit("<<<"))).when(k % 4 == 2, "A!").otherwise(F.concat(F.lit("PO"), F.lpad(s, 6, "0")))
    r = val.validate_field("passport", v, F.lit(0.9), AS_OF)
    return table(spark, sf_dir, "customer").select("c_custkey", r["value"].alias("value"), F.array_join(r["issues"], ";").alias("issues"))


@query(
    "import_states",
    """WITH r AS (SELECT ['ready', 'Need-Review', '', 'missing data', 'odd', 'FILLED'][(o_orderkey % 6 + 1)::INT] AS raw, CASE WHEN o_orderkey % 4 < 2 THEN 'PASSPORT' ELSE 'ID_CARD' END AS doc, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'n' END AS num FROM orders)
    SELECT raw, doc, num, CASE raw WHEN 'ready' THEN 'READY' WHEN 'Need-Review' THEN 'NEED_REVIEW' WHEN 'missing data' THEN 'MISSING_DATA' WHEN 'FILLED' THEN 'FILLED' WHEN '' THEN CASE WHEN num = '' THEN 'MISSING_DATA' ELSE 'NEED_REVIEW' END ELSE 'NEED_REVIEW' END AS status, count(*) AS n FROM r GROUP BY ALL""",
)
def import_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.element_at(F.array(*map(F.lit, ["ready", "Need-Review", "", "missing data", "odd", "FILLED"])), (k % 6 + 1).cast("int"))
    r = table(spark, sf_dir, "orders").select(raw.alias("raw"), F.when(k % 4 < 2, "PASSPORT").otherwise("ID_CARD").alias("doc"), F.when(k % 3 == 0, "").otherwise("n").alias("num"))
    return r.groupBy("raw", "doc", "num", val.import_status(F.col("raw"), F.col("doc"), F.col("num"), F.col("num")).alias("status")).agg(F.count("*").alias("n"))


@query(
    "safety_checks",
    """WITH r AS (SELECT concat_ws(';', CASE WHEN o_orderstatus = 'P' THEN 'status' END, CASE WHEN NOT o_totalprice < 300000 THEN 'price' END, CASE WHEN NOT contains(o_orderpriority, 'URG') AND NOT regexp_matches(o_orderpriority, '[0-9]-.*H') THEN 'pattern' END) AS failed FROM orders) SELECT failed, failed = '' AS passed, count(*) AS n FROM r GROUP BY ALL""",
)
def safety_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    c = val.check_list({"status": F.col("o_orderstatus") != "P", "price": F.col("o_totalprice") < 300000, "pattern": val.glob_match("URG", p) | val.glob_match("-*H", p)})
    return table(spark, sf_dir, "orders").groupBy(F.array_join(c["failed"], ";").alias("failed"), c["passed"].alias("passed")).agg(F.count("*").alias("n"))


@query(
    "accuracy_blend",
    """SELECT o_orderkey, round(least(1.0, CASE WHEN o_orderstatus = 'P' THEN 0.4 ELSE 1 END, CASE WHEN o_custkey % 3 = 0 THEN 0.7 ELSE 1 END) * (1 - w) + c * w, 6) AS accuracy
    FROM (SELECT *, (o_orderkey % 20) / 20.0 AS c, CASE WHEN o_orderkey % 20 >= 18 THEN 0.3 WHEN o_orderkey % 20 >= 14 THEN 0.4 ELSE 0.5 END AS w FROM orders)""",
)
def accuracy_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = val.accuracy(F.col("o_orderkey") % 20 / 20, [(F.col("o_orderstatus") == "P", 0.4), (F.col("o_custkey") % 3 == 0, 0.7)])
    return table(spark, sf_dir, "orders").select("o_orderkey", exact(a).alias("accuracy"))


@query("merge_options", "SELECT event_id, coalesce(props->>'k', '7') AS k, 'default' AS other FROM events")
def merge_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = val.merged_options(F.from_json("props", "map<string,string>"), {"k": "7", "other": "default"})
    return table(spark, sf_dir, "events").select("event_id", m["k"].alias("k"), m["other"].alias("other"))
