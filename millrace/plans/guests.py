"""Queries over guest records: import, search, summaries, scores, conflicts, mapping and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.operators import records, windows
from millrace.plans.registry import exact, query, table


@query("guest_search", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE (contains(lower(c_name), '00012') OR contains(lower(c_mktsegment), '00012')) AND c_mktsegment = 'MACHINERY'")
def guest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return records.search(c, "00012", ("c_name", "c_mktsegment"), {"c_mktsegment": "MACHINERY", "c_name": "ALL"})


@query("guest_sort", "SELECT c_custkey, c_name FROM customer ORDER BY c_mktsegment, c_custkey LIMIT 25 OFFSET 10")
def guest_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.operators.audit import page

    return page(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), [F.col("c_mktsegment"), F.col("c_custkey")], 10, 25).select("c_custkey", "c_name")


@query(
    "import_rows",
    """SELECT trim(c_name) AS "fullName", c_custkey::VARCHAR AS "passportNumber", CASE WHEN c_nationkey = 3 THEN '' ELSE c_nationkey::VARCHAR END AS nationality,
              CASE WHEN c_acctbal / 10000 BETWEEN 0 AND 1 THEN round(c_acctbal / 10000, 6) END AS score FROM customer WHERE c_custkey % 11 <> 0""",
)
def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    raw = c.select(
        F.when(F.col("c_custkey") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name")).alias("Full Name"),
        F.lit("second").alias("name"),
        F.col("c_custkey").alias("passport_no"),
        F.when(F.col("c_nationkey") == 3, None).otherwise(F.col("c_nationkey")).alias("Country"),
        (F.col("c_acctbal") / 10000).alias("fullName_conf"),
    )
    out = records.import_rows(raw)
    return out.select("fullName", "passportNumber", "nationality", exact(out["fieldConfidence"]["fullName"]).alias("score"))


@query(
    "import_summary",
    """WITH d AS (SELECT o_orderpriority AS sheet, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_custkey::VARCHAR END AS doc FROM orders)
    SELECT sheet, count(*) AS n_rows, count(*) FILTER (doc = '') AS no_document, count(*) FILTER (doc <> '') - count(DISTINCT doc) FILTER (doc <> '') AS duplicates FROM d GROUP BY ALL""",
)
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_custkey").cast("string"))
    d = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("sheet"), doc.alias("doc"))
    return d.groupBy("sheet").agg(F.count("*").alias("n_rows"), F.count_if(F.col("doc") == "").alias("no_document"), (F.count_if(F.col("doc") != "") - F.count_distinct(F.nullif("doc", F.lit("")))).alias("duplicates"))


@query(
    "duplicate_rows",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN false ELSE row_number() OVER (PARTITION BY CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_custkey::VARCHAR END ORDER BY o_orderkey) > 1 END AS duplicate FROM orders""",
)
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_custkey").cast("string"))
    return windows.duplicates(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), doc, ["o_orderkey"]).select("o_orderkey", "duplicate")


_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'O' THEN 'NEED_REVIEW' ELSE 'FAILED' END"


@query(
    "job_summary",
    f"""WITH r AS (SELECT o_orderpriority AS job, o_custkey AS file, {_STATUS} AS status, (o_orderkey % 100) / 100.0 AS c FROM orders)
    SELECT job, count(DISTINCT file) AS files, count(*) AS n_rows, count(*) FILTER (status = 'READY') AS ready, count(*) FILTER (status = 'NEED_REVIEW') AS review, 0::BIGINT AS missing,
           count(*) FILTER (status = 'FAILED') AS failed, round(avg(c), 2) AS mean_confidence FROM r GROUP BY ALL""",
)
def job_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "READY").when(F.col("o_orderstatus") == "O", "NEED_REVIEW").otherwise("FAILED")
    r = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("job"), F.col("o_custkey").alias("file"), status.alias("status"), (F.col("o_orderkey") % 100 / 100).alias("c"))
    return records.job_summary(r, ["job"], "file", "status", "c")


@query(
    "level_histogram",
    "SELECT flag, count(*) FILTER (s >= 0.9) AS high, count(*) FILTER (s >= 0.7 AND s < 0.9) AS medium, count(*) FILTER (s < 0.7) AS low FROM (SELECT l_returnflag AS flag, l_quantity / 50.0 AS s FROM lineitem) GROUP BY ALL",
)
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = rules.level(F.col("l_quantity") / 50.0)
    r = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), level.alias("level"))
    return r.groupBy("flag").agg(*[F.count_if(F.col("level") == n).alias(n.lower()) for n in ("HIGH", "MEDIUM", "LOW")])


@query(
    "weighted_confidence",
    """WITH f AS (SELECT l_orderkey, l_discount * 10 AS s, CASE l_linenumber WHEN 1 THEN 1.5 WHEN 2 THEN 1.5 WHEN 4 THEN 0.8 ELSE 1.0 END * CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS w FROM lineitem)
    SELECT l_orderkey, round(CASE WHEN sum(w) > 0 THEN sum(s * w) / sum(w) ELSE 0 END, 6) AS confidence FROM f GROUP BY ALL""",
)
def weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted mean over non-empty fields."""
    n = F.col("l_linenumber")
    weight = F.when(n.isin(1, 2), 1.5).when(n == 4, 0.8).otherwise(1.0) * F.when(F.col("l_returnflag") == "N", 1).otherwise(0)
    f = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("s"), weight.alias("w"))
    return f.groupBy("l_orderkey").agg(exact(records.weighted_confidence(F.col("s"), F.col("w"))).alias("confidence"))


@query(
    "aggregate_accuracy",
    """WITH g AS (SELECT l_orderkey, avg(l_quantity / 50.0) AS m, count(*) FILTER (l_discount >= 0.09) AS issues FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, round(greatest(0, least(1, m - 0.1 * issues)), 6) AS score FROM g""",
)
def aggregate_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.avg(F.col("l_quantity") / 50.0).alias("m"), F.count_if(F.col("l_discount") >= 0.09).alias("issues"))
    return g.select("l_orderkey", exact(rules.clamp(F.col("m") - F.col("issues") * 0.1)).alias("score"))


_CONFLICT = """CASE WHEN m = '' THEN v WHEN v = '' THEN m WHEN upper(trim(m)) = upper(trim(v)) THEN m WHEN digit OR c < 0.6 THEN m ELSE v END AS value,
    CASE WHEN m = '' THEN 'visual' WHEN v = '' THEN 'mrz' WHEN upper(trim(m)) = upper(trim(v)) THEN 'mrz' WHEN digit THEN 'mrz' WHEN c < 0.6 THEN 'mrz_repaired' ELSE 'visual' END AS source,
    round(CASE WHEN m = '' THEN c WHEN v = '' THEN 0.95 WHEN upper(trim(m)) = upper(trim(v)) THEN CASE WHEN digit THEN 0.98 ELSE 0.88 END WHEN digit THEN 0.95 WHEN c < 0.6 THEN 0.85 ELSE c END, 6) AS confidence,
    CASE WHEN m = '' OR v = '' OR upper(trim(m)) = upper(trim(v)) THEN false WHEN digit OR c < 0.6 THEN true ELSE c < 0.7 END AS conflict"""


@query(
    "resolve_conflicts",
    f"""WITH visual AS (SELECT c_custkey AS doc, c_mktsegment AS visual, (c_custkey % 20) / 20.0 AS confidence FROM customer),
    zone AS (SELECT c_custkey + 100 AS doc, CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) || ' ' WHEN 1 THEN 'OTHER' WHEN 2 THEN '' ELSE 'X' END AS mrz, c_custkey % 8 < 4 AS digit FROM customer),
    j AS (SELECT doc, coalesce(mrz, '') AS m, coalesce(visual, '') AS v, coalesce(digit, false) AS digit, coalesce(confidence, 0) AS c FROM visual FULL JOIN zone USING (doc))
    SELECT doc, {_CONFLICT} FROM j""",
)
def resolve_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    visual = c.select(k.alias("doc"), s.alias("visual"), (k % 20 / 20).alias("confidence"))
    mrz = F.when(k % 4 == 0, F.concat(F.lower(s), F.lit(" "))).when(k % 4 == 1, "OTHER").when(k % 4 == 2, "").otherwise("X")
    zone = c.select((k + 100).alias("doc"), mrz.alias("mrz"), (k % 8 < 4).alias("digit"))
    out = records.resolve_conflicts(visual, zone, ["doc"])
    return out.select("doc", "value", "source", exact(F.col("confidence")).alias("confidence"), "conflict")


@query(
    "conflict_remainder",
    """WITH results AS (SELECT c_custkey AS doc, c_name AS value FROM customer), better AS (SELECT c_custkey + 100 AS doc, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'b' || c_custkey END AS value FROM customer)
    SELECT doc, coalesce(b.value, r.value) AS value FROM results r LEFT JOIN better b USING (doc) UNION ALL SELECT doc, value FROM better WHERE doc NOT IN (SELECT doc FROM results) AND value <> ''""",
)
def conflict_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("c_custkey")
    results = c.select(k.alias("doc"), F.col("c_name").alias("value"))
    better = c.select((k + 100).alias("doc"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("b"), k.cast("string"))).alias("value"))
    return records.with_remainder(results, better, ["doc"])


@query(
    "unpivot_fields",
    """SELECT c_custkey, unnest([0, 1, 2]) AS position, unnest(['c_name', 'c_mktsegment', 'c_nationkey']) AS field, unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) AS value FROM customer""",
)
def unpivot_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.unpivot_fields(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


MAPPINGS = [
    {"source": "c_name", "target": "guest", "transforms": [{"type": "lowercase"}]},
    {"source": "c_mktsegment", "target": "segment", "transforms": [{"type": "custom_mapping", "mapping": {"BUILDING": "B"}}]},
    {"source": "c_nationkey", "target": "nation", "enabled": False},
    {"source": "c_name", "target": "segment2", "transforms": [{"type": "replace", "from": "Customer", "to": "C"}]},
]


@query("apply_mappings", "SELECT c_custkey, lower(c_name) AS guest, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' ELSE c_mktsegment END AS segment, replace(c_name, 'Customer', 'C') AS segment2 FROM customer")
def apply_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.apply_mappings(table(spark, sf_dir, "customer"), MAPPINGS, ["c_custkey"])


@query("mapping_report", "SELECT c_custkey, 'c_nationkey;c_acctbal' AS unmapped, 'nation' AS missing_targets FROM customer")
def mapping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records.mapping_report(table(spark, sf_dir, "customer"), MAPPINGS, ["c_name", "c_nationkey", "c_acctbal"], ["guest", "nation"], "c_custkey")
    return r.select("c_custkey", F.array_join("unmapped", ";").alias("unmapped"), F.array_join("missing_targets", ";").alias("missing_targets"))


@query(
    "duplicate_mappings",
    """WITH m AS (SELECT p_partkey, p_brand AS source, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS target FROM part)
    SELECT p_partkey, count(*) OVER (PARTITION BY source, target) > 1 AS duplicate, count(*) OVER (PARTITION BY lower(target)) > 1 AND NOT count(*) OVER (PARTITION BY source, target) > 1 AS similar FROM m""",
)
def duplicate_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name"))
    m = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("source"), target.alias("target"))
    return records.duplicate_mappings(m).select("p_partkey", "duplicate", "similar")


@query(
    "fill_outcomes",
    """WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N') AS filled, count(*) FILTER (l_returnflag = 'A') AS failed, count(*) FILTER (l_returnflag = 'R') AS skipped FROM lineitem GROUP BY ALL)
    SELECT CASE WHEN failed = 0 AND skipped = 0 THEN 'SUCCESS' WHEN filled > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS outcome, count(*) AS n FROM c GROUP BY ALL""",
)
def fill_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.count_if(flag == f).alias(n) for f, n in (("N", "filled"), ("A", "failed"), ("R", "skipped"))])
    return c.groupBy(records.outcome(F.col("filled"), F.col("failed"), F.col("skipped")).alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "overlay_edits",
    """WITH e AS (SELECT c_custkey + 100 AS c_custkey, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'edited' END AS c_name, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS c_mktsegment FROM customer)
    SELECT c.c_custkey, coalesce(e.c_name, c.c_name) AS c_name, coalesce(e.c_mktsegment, c.c_mktsegment) AS c_mktsegment, CASE WHEN e.c_name IS NOT NULL AND e.c_name <> c.c_name THEN 1 ELSE 0 END + CASE WHEN e.c_mktsegment <> c.c_mktsegment THEN 1 ELSE 0 END AS n_edits FROM customer c LEFT JOIN e USING (c_custkey)""",
)
def overlay_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("c_custkey")
    edits = c.select((k + 100).alias("c_custkey"), F.when(k % 6 == 0, "").otherwise("edited").alias("c_name"), F.when(k % 4 == 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return records.overlay(c, edits, "c_custkey", ["c_name", "c_mktsegment"])


@query(
    "form_issues",
    r"""WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END AS p, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderstatus END AS s, o_totalprice AS t FROM orders)
    SELECT o_orderkey, concat_ws(';', CASE WHEN trim(p) = '' THEN 'REQUIRED' ELSE nullif(concat_ws(';', CASE WHEN length(p) < 6 THEN 'TOO_SHORT' END, CASE WHEN length(p) > 10 THEN 'TOO_LONG' END, CASE WHEN NOT regexp_matches(p, '^[1-3]-') THEN 'PATTERN' END), '') END,
           CASE WHEN t > 200000 THEN 'TOO_EXPENSIVE' END) AS priority, CASE WHEN trim(s) <> '' AND NOT regexp_matches(s, '^[FO]$') THEN 'PATTERN' ELSE '' END AS status FROM f""",
)
def form_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(k % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("p"), F.when(k % 5 == 0, " ").otherwise(F.col("o_orderstatus")).alias("s"))
    m = rules.form_issues({"p": F.col("p"), "s": F.col("s")}, {"p": {"required": True, "min_length": 6, "max_length": 10, "pattern": "^[1-3]-"}, "s": {"pattern": "^[FO]$"}}, (("p", F.col("o_totalprice") > 200000, "TOO_EXPENSIVE"),))
    return o.select("o_orderkey", *[F.coalesce(F.array_join(F.try_element_at(m, F.lit(f)), ";"), F.lit("")).alias(n) for f, n in (("p", "priority"), ("s", "status"))])


@query(
    "quality_checks",
    """WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS blur, l_extendedprice / 300 AS brightness, l_quantity AS contrast, l_discount * 3 AS glare, (l_tax - 0.04) * 200 AS skew, l_suppkey * 20 AS width FROM lineitem),
    w AS (SELECT *, list_filter([CASE WHEN blur < 50 THEN 'BLURRY' END, CASE WHEN brightness < 50 THEN 'TOO_DARK' END, CASE WHEN brightness > 220 THEN 'OVEREXPOSED' END, CASE WHEN contrast < 30 THEN 'LOW_CONTRAST' END, CASE WHEN glare > 0.15 THEN 'GLARE' END,
          CASE WHEN abs(skew) > 5 THEN 'SKEWED' END, CASE WHEN width < 600 THEN 'LOW_RESOLUTION' END], lambda x: x IS NOT NULL) AS w FROM m)
    SELECT l_orderkey, l_linenumber, array_to_string(w, ';') AS warnings,
           round(least(0.3, coalesce(list_sum(list_transform(w, lambda x: CASE x WHEN 'BLURRY' THEN 0.15 WHEN 'LOW_CONTRAST' THEN 0.08 WHEN 'SKEWED' THEN 0.05 ELSE 0.1 END)), 0)), 6)::DOUBLE AS penalty FROM w""",
)
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    w = rules.quality_warnings(q * 2, F.col("l_extendedprice") / 300, q, F.col("l_discount") * 3, (F.col("l_tax") - 0.04) * 200, F.col("l_suppkey") * 20, F.lit(500), F.lit(1.0), (600, 450))
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", w.alias("w"))
    return m.select("l_orderkey", "l_linenumber", F.array_join("w", ";").alias("warnings"), exact(rules.quality_penalty(F.col("w"))).alias("penalty"))


@query(
    "field_scores",
    """WITH f AS (SELECT o_orderkey, (o_orderkey % 100) / 100.0 AS ocr, o_custkey % 2 = 0 AS digit, CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 4 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS v, o_orderkey % 9 = 0 AS blank, o_orderkey % 4 = 0 AS bad FROM orders)
    SELECT o_orderkey, round(greatest(0.0, least(1.0, 0.2 + 0.8 * ocr + CASE WHEN digit THEN 0.1 ELSE -0.2 END - CASE WHEN blank THEN 0.2 ELSE 0 END - CASE WHEN ocr < 0.5 THEN 0.15 ELSE 0 END - CASE WHEN NOT blank AND bad THEN 0.15 ELSE 0 END)) - 0.05, 6) AS score FROM f""",
)
def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = F.when(k % 9 == 0, "").when(k % 4 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", exact(rules.field_score(k % 100 / 100, F.col("o_custkey") % 2 == 0, v, "date", 0.05)).alias("score"))


@query(
    "review_states",
    """WITH s AS (SELECT o_orderkey, (o_orderkey % 5)::INT AS empty, o_orderstatus = 'P' AS errors, o_custkey % 3 = 0 AS review, o_custkey % 4 <> 0 AS resolved FROM orders),
    r AS (SELECT *, concat_ws(';', CASE WHEN empty > 0 THEN 'MISSING_CRITICAL_FIELD' END, CASE WHEN errors THEN 'VALIDATION_ERROR' END, CASE WHEN review THEN 'FIELD_NEEDS_REVIEW' END, CASE WHEN NOT resolved THEN 'UNRESOLVED_FIELD' END) AS reasons FROM s)
    SELECT CASE WHEN empty >= 3 THEN 'FAILED' WHEN reasons <> '' THEN 'NEED_REVIEW' ELSE 'AUTO_FILLED' END AS status, reasons, count(*) AS n FROM r GROUP BY ALL""",
)
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = rules.review_status(c % 4 != 0, c % 3 == 0, F.col("o_orderstatus") == "P", k % 5)
    return table(spark, sf_dir, "orders").groupBy(s["status"].alias("status"), F.array_join(s["reasons"], ";").alias("reasons")).agg(F.count("*").alias("n"))


@query(
    "resolve_fields",
    """WITH f AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END AS m, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS v, c_custkey % 2 = 0 AS d, (c_custkey % 10) / 10.0 AS c FROM customer)
    SELECT c_custkey, CASE WHEN v <> '' AND (m = '' OR NOT d) THEN v ELSE m END AS value, CASE WHEN v <> '' AND (m = '' OR NOT d) THEN 'visual' WHEN m <> '' THEN 'mrz' ELSE 'unresolved' END AS source,
           round(CASE WHEN v <> '' AND m <> '' AND NOT d THEN greatest(0.65, c) WHEN v <> '' AND m = '' THEN greatest(0.5, c) WHEN m <> '' AND d THEN 0.98 WHEN m <> '' THEN 0.85 ELSE 0 END, 6) AS confidence FROM f""",
)
def resolve_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    r = rules.resolve_field(F.when(k % 5 == 0, "").otherwise(F.col("c_name")), k % 2 == 0, F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")), k % 10 / 10)
    return table(spark, sf_dir, "customer").select("c_custkey", r["value"].alias("value"), r["source"].alias("source"), exact(r["confidence"]).alias("confidence"))


@query(
    "failed_rows",
    """SELECT o_orderkey::VARCHAR AS id, 'READY' AS status, '' AS warning FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'ROW_FAILED_' || o_orderkey, 'FAILED', 'LOAD_ERROR' FROM orders WHERE o_orderstatus = 'P'""",
)
def failed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows and, for each failed input, a row that says so."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    good = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("READY").alias("status"), F.lit("").alias("warning"))
    bad = o.where("o_orderstatus = 'P'").select(F.concat(F.lit("ROW_FAILED_"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("FAILED").alias("status"), F.lit("LOAD_ERROR").alias("warning"))
    return good.unionByName(bad)


@query("candidate_variants", "SELECT n_nationkey, psm, psm * 100 + n_nationkey AS candidate FROM nation CROSS JOIN (VALUES (6), (7), (11), (13)) AS p(psm)")
def candidate_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image with each of four recogniser modes: an exploded constant list, no join."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, (6, 7, 11, 13)))).alias("psm"))
    return n.select("n_nationkey", "psm", (F.col("psm") * 100 + F.col("n_nationkey")).alias("candidate"))


@query("guests_by_country", "SELECT n_name, count(*) AS guests, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def guests_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal").groupBy("c_nationkey").agg(F.count("*").alias("guests"), F.sum("c_acctbal").alias("balance"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.sum("guests").alias("guests"), exact(F.sum("balance"), 2).alias("balance"))


@query("labelled_documents", "SELECT d.doc_id, d.lang, quality FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 0")
def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return d.join(table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id", "quality"), "doc_id")


@query("unlabelled_documents", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
