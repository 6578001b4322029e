"""Queries over the rules of the front desk, names that may be one person's, profiles and their mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import desk
from millrace.operators import names, profiles
from millrace.plans.registry import AS_OF, exact, query, table
from millrace.plans.texts import _SOUND

_GENERIC = "regexp_full_match(v, '[A-Za-z0-9]{5,20}')"
_UNSURE = "(length(v) - length(regexp_replace(upper(v), '[0O1I5S8B2Z6G9]', '', 'g')))"
_CODES = ("US", "chn", "FRA", "MEX", "VN", "XYZ", "")


@query(
    "passport_accuracy",
    f"""WITH r AS (SELECT c_custkey, ['US', 'chn', 'FRA', 'MEX', 'VN', 'XYZ', ''][c_custkey % 7 + 1] AS nat, CASE c_custkey % 5 WHEN 0 THEN lpad(c_custkey::VARCHAR, 9, '3') WHEN 1 THEN 'e' || lpad(c_custkey::VARCHAR, 7, '4')
        WHEN 2 THEN '00000000' WHEN 3 THEN 'N-' || c_custkey ELSE '12AB' || lpad(c_custkey::VARCHAR, 5, '7') END AS v FROM customer),
    f AS (SELECT *, CASE WHEN nat = 'US' THEN regexp_full_match(v, '[0-9]{{9}}') WHEN nat = 'chn' THEN regexp_full_match(upper(v), '[A-Z][0-9]{{7,8}}') WHEN nat = 'FRA' THEN regexp_full_match(upper(v), '[0-9]{{2}}[A-Z]{{2}}[0-9]{{5}}')
        WHEN nat = 'MEX' THEN regexp_full_match(upper(v), '[0-9]{{8}}|[A-Z][0-9]{{7}}') WHEN nat = 'VN' THEN regexp_full_match(upper(v), '[A-Z][0-9]{{7}}') ELSE {_GENERIC} END AS fits, {_UNSURE} AS unsure FROM r)
    SELECT c_custkey, fits, round(least(1 - least(0.2, unsure * 0.05), CASE WHEN {_GENERIC} THEN 1 ELSE 0.3 END, CASE WHEN regexp_full_match(v, '0+') THEN 0.1 ELSE 1 END, CASE WHEN nat <> '' AND NOT fits THEN 0.4 ELSE 1 END), 6)::DOUBLE AS score,
        concat_ws(';', CASE WHEN unsure > 0 THEN 'AMBIGUOUS_CHARS' END, CASE WHEN NOT {_GENERIC} THEN 'INVALID_FORMAT' END, CASE WHEN regexp_full_match(v, '0+') THEN 'ZERO_FILLED' END, CASE WHEN nat <> '' AND NOT fits THEN 'COUNTRY_FORMAT' END) AS issues,
        round(least(1 - least(0.15, unsure * 0.03), CASE WHEN regexp_full_match(v, '[A-Za-z0-9]{{5,30}}') THEN 1 ELSE 0.3 END), 6)::DOUBLE AS card_score FROM f""",
)
def passport_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of five shapes under seven nationalities."""
    k = F.col("c_custkey")
    key = k.cast("string")
    v = F.when(k % 5 == 0, F.lpad(key, 9, "3")).when(k % 5 == 1, F.concat(F.lit("e"), F.lpad(key, 7, "4"))).when(k % 5 == 2, "00000000").when(k % 5 == 3, F.concat(F.lit("N-"), key)).otherwise(F.concat(F.lit("12AB"), F.lpad(key, 5, "7")))
    nation = F.element_at(F.array(*map(F.lit, _CODES)), (k % len(_CODES) + 1).cast("int"))
    t = table(spark, sf_dir, "customer").select(k, v.alias("v"), nation.alias("nat"))
    a = desk.passport_accuracy(F.col("v"), F.col("nat"))
    return t.select(k, desk.passport_fits(F.col("v"), F.col("nat")).alias("fits"), exact(a["score"]).alias("score"), F.array_join(a["issues"], ";").alias("issues"), exact(desk.card_accuracy(F.col("v"))["score"]).alias("card_score"))


@query(
    "zone_line_choice",
    """WITH r AS (SELECT c_custkey, c_custkey % 4 AS k, 'P<UTO' || replace(upper(c_name), '#', '<') AS name, lpad(c_custkey::VARCHAR, 9, '1') || 'UTO740812' AS num FROM customer),
    l AS (SELECT c_custkey, k, rpad(name, 44, '<') AS a, rpad(num, 42, '<') || '10' AS b, rpad(name, 40, '<') AS c, rpad(num, 31, '<') AS d FROM r)
    SELECT c_custkey, CASE k WHEN 0 THEN a || ' ' || b WHEN 1 THEN a || ' ' || b ELSE c || ' ' || d END AS chosen FROM l""",
)
def zone_line_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines among others, whole lines turned round, and lines of odd lengths in the wrong order and twice."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("P<UTO"), F.replace(F.upper("c_name"), F.lit("#"), F.lit("<")))
    number = F.concat(F.lpad(k.cast("string"), 9, "1"), F.lit("UTO740812"))
    a, b, c, d = F.rpad(name, 44, "<"), F.concat(F.rpad(number, 42, "<"), F.lit("10")), F.rpad(name, 40, "<"), F.rpad(number, 31, "<")
    lines = F.when(k % 4 == 0, F.array(F.lit("REPUBLIC OF UTOPIA"), a, b)).when(k % 4 == 1, F.array(F.reverse(a), F.reverse(b), F.lit("XX"))).otherwise(F.array(d, F.lit("short"), c, d))
    t = table(spark, sf_dir, "customer").select(k, lines.alias("lines"))
    return t.select(k, F.array_join(desk.zone_lines(F.col("lines")), " ").alias("chosen"))


@query(
    "job_reports",
    f"""SELECT event_id, '{AS_OF}' AS generated_at, event_type AS summary, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error_count,
        CASE WHEN event_id % 3 = 0 THEN '' ELSE 'concurrency=' || user_id || CASE WHEN event_id % 3 = 2 THEN '' ELSE ';enablePdfInput=true' END END AS options, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'concurrency=' || user_id END AS short_options FROM events""",
)
def job_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    own = F.create_map(F.lit("apiKey"), F.lit("x"), F.lit("concurrency"), F.col("user_id").cast("string"))
    options = F.when(e % 3 == 1, F.map_concat(own, F.create_map(F.lit("enablePdfInput"), F.lit("true")))).when(e % 3 == 2, own)
    r, s = (desk.report(e, options, F.col("event_type"), (F.col("event_type") == "error").cast("int"), short, AS_OF) for short in (False, True))

    def flat(m: F.Column) -> F.Column:
        return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda p: F.concat_ws("=", p["key"], p["value"])), ";")

    return table(spark, sf_dir, "events").select(e, r["generated_at"].alias("generated_at"), r["summary"].alias("summary"), r["error_count"].alias("error_count"), flat(r["options_used"]).alias("options"), flat(s["options_used"]).alias("short_options"))


@query(
    "similar_names",
    f"""WITH w AS (SELECT DISTINCT upper(trim(p_name)) AS x FROM part), s AS (SELECT x, regexp_replace(x, '[^A-Z]', '', 'g') AS u FROM w), c AS (SELECT x, {_SOUND.format(u="u")} AS code FROM s),
    m AS (SELECT x, min(x) OVER (PARTITION BY code) AS y FROM c WHERE length(x) >= 3)
    SELECT x AS name, y AS other, 0.85::DOUBLE AS similarity, 'soundex' AS method FROM m WHERE x > y
    UNION ALL SELECT a.x, b.x, round(1 - levenshtein(a.x, b.x) / greatest(length(a.x), length(b.x)), 6), 'levenshtein' FROM c a JOIN c b ON a.x > b.x AND a.code <> b.code AND levenshtein(a.x, b.x) * 10 <= greatest(length(a.x), length(b.x)) * 3""",
)
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = names.similar_names(table(spark, sf_dir, "part"), "p_name")
    return found.select("name", "other", exact(F.col("similarity")).alias("similarity"), "method")


@query(
    "default_profile",
    f"SELECT s_suppkey AS id, s_name AS name, s_suppkey = 3 AS is_default, '{AS_OF}' AS updated_at, NULL::VARCHAR AS target FROM supplier UNION ALL SELECT -1, 'new', FALSE, '{AS_OF}', 'copy_assistant'",
)
def default_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(True).alias("is_default"), F.lit("").alias("updated_at"))
    return profiles.with_profile(profiles.with_default(p, 3, AS_OF), -1, "new", AS_OF)


@query(
    "edited_mappings",
    """WITH base AS (SELECT o_custkey AS profile_id, o_orderkey AS mapping_id, o_orderpriority AS target FROM orders WHERE o_orderstatus <> 'F'),
    k AS (SELECT l_orderkey AS mapping_id, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 2 WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS op FROM lineitem),
    e AS (SELECT mapping_id, op, op || ' ' || l_linenumber AS target, l_linenumber * 3 + op AS pos FROM k),
    g AS (SELECT *, max(CASE WHEN op = 2 THEN pos END) OVER (PARTITION BY mapping_id) AS gone FROM e),
    h AS (SELECT *, min(CASE WHEN op = 0 AND (gone IS NULL OR pos > gone) THEN pos END) OVER (PARTITION BY mapping_id) AS added FROM g),
    last AS (SELECT o_custkey AS profile_id, mapping_id, max(gone) AS gone, max_by(h.target, pos) FILTER (op < 2 AND (gone IS NULL OR pos > gone) AND ((o_orderstatus <> 'F' AND gone IS NULL) OR pos >= added)) AS target FROM h JOIN orders ON o_orderkey = mapping_id GROUP BY ALL)
    SELECT profile_id, mapping_id, coalesce(last.target, CASE WHEN gone IS NULL THEN base.target END) AS target FROM base FULL JOIN last USING (profile_id, mapping_id) WHERE coalesce(last.target, CASE WHEN gone IS NULL THEN base.target END) IS NOT NULL""",
)
def edited_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mappings, their lines as edits in the order of line numbers, some of them of mappings that are not there."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("profile_id"), F.col("o_orderkey").alias("mapping_id"), F.col("o_orderpriority").alias("target"), "o_orderstatus")
    removed, added = F.col("l_linestatus") == "O", F.col("l_returnflag") == "A"
    op = F.when(removed, "remove").when(added, "add").otherwise("update")
    target = F.concat(F.when(removed, "2 ").when(added, "0 ").otherwise("1 "), F.col("l_linenumber").cast("string"))
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mapping_id"), op.alias("op"), F.col("l_linenumber").alias("at"), target.alias("target"))
    return profiles.edited_mappings(o.where("o_orderstatus <> 'F'"), e.join(o.select("profile_id", "mapping_id"), "mapping_id"), ["target"])


@query(
    "mappings_or_defaults",
    """WITH m AS (SELECT o_orderkey // 3 AS profile_id, o_orderpriority AS source, o_orderstatus AS target, o_orderstatus = 'O' AS required FROM orders),
    good AS (SELECT profile_id FROM m GROUP BY ALL HAVING count(*) = count(DISTINCT source) AND bool_and(source <> '5-LOW'))
    SELECT profile_id, source, target, required, TRUE AS enabled, TRUE AS stored FROM m SEMI JOIN good USING (profile_id)
    UNION ALL SELECT o_orderkey, d.source, d.target, d.required, TRUE, FALSE FROM orders CROSS JOIN (VALUES ('number', 'passport', TRUE), ('name', 'name', FALSE)) d(source, target, required) WHERE o_orderkey NOT IN (SELECT profile_id FROM good)""",
)
def mappings_or_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three orders each as the mappings of a profile; two thirds of the profiles have none."""
    t = table(spark, sf_dir, "orders")
    o = t.select(F.floor(F.col("o_orderkey") / 3).alias("profile_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("target"), (F.col("o_orderstatus") == "O").alias("required"), F.lit(True).alias("enabled"))
    defaults = [{"source": "number", "target": "passport", "required": True}, {"source": "name", "required": False}]
    return profiles.mappings_or_defaults(t.select(F.col("o_orderkey").alias("id")), o, defaults, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"])
