"""Queries over names, numbers, dates, masks and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates, masks
from millrace.functions import text as tx
from millrace.functions.dims import ISO2_TO_ISO3, ISO3_TO_NAME
from millrace.plans.registry import AS_OF, exact, query, table
from millrace.sources import pages as page_source


@query(
    "normalize_fields",
    """SELECT c_custkey, upper(trim(regexp_replace(replace(replace(c_name, '#', '<<'), '<', ' '), '\\s+', ' ', 'g'))) AS name,
              regexp_replace(upper(trim('ab' || c_custkey || '<<')), '<+$', '') AS number_worker, replace(upper(trim('a<b' || c_custkey || '<')), '<', '') AS number_service,
              regexp_replace('aB' || c_custkey || '<', '[^A-Z0-9]', '', 'g') AS number_util,
              CASE c_nationkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'F' ELSE 'UNKNOWN' END AS gender
       FROM customer""",
)
def normalize_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    key = F.col("c_custkey").cast("string")
    word = F.element_at(F.array(F.lit(" male"), F.lit("nữ"), F.lit("Female"), F.lit("<")), F.col("c_nationkey") % 4 + 1)
    return c.select(
        "c_custkey",
        tx.normalize_name(F.replace("c_name", F.lit("#"), F.lit("<<"))).alias("name"),
        tx.normalize_document_number(F.concat(F.lit("ab"), key, F.lit("<<"))).alias("number_worker"),
        tx.normalize_document_number(F.concat(F.lit("a<b"), key, F.lit("<")), "service").alias("number_service"),
        tx.normalize_document_number(F.concat(F.lit("aB"), key, F.lit("<")), "util").alias("number_util"),
        tx.normalize_gender(word).alias("gender"),
    )


def _values(table_: dict[str, str]) -> str:
    return ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in table_.items())


@query(
    "country_lookup",
    f"""WITH two(a, b) AS (VALUES {_values(ISO2_TO_ISO3)}), three(b, name) AS (VALUES {_values(ISO3_TO_NAME)}),
    codes AS (SELECT n_nationkey, ['VN', 'us', 'XX', 'FR', 'deu'][n_nationkey % 5 + 1] AS code FROM nation)
    SELECT n_nationkey, coalesce(two.b, substr(upper(code), 1, 3)) AS iso3, coalesce(three.name, t3.name, code) AS name
    FROM codes LEFT JOIN two ON two.a = upper(code) LEFT JOIN three ON three.b = two.b LEFT JOIN three t3 ON t3.b = upper(code)""",
)
def country_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, ["VN", "us", "XX", "FR", "deu"])), F.col("n_nationkey") % 5 + 1)
    return table(spark, sf_dir, "nation").select("n_nationkey", tx.normalize_country(code).alias("iso3"), tx.format_country(code, "NAME").alias("name"))


RULES = [{"type": "trim"}, {"type": "replace", "from": "#", "to": " "}, {"type": "strip", "chars": "0"}, {"type": "uppercase"}, {"type": "prefix", "value": "<"}, {"type": "suffix", "value": ">"}, {"type": "custom_mapping", "mapping": {"<CUSTOMER 1>": "first"}}]


@query(
    "transform_rules",
    """WITH t AS (SELECT c_custkey, '<' || upper(replace(replace(trim(c_name), '#', ' '), '0', '')) || '>' AS r FROM customer)
    SELECT c_custkey, CASE WHEN r = '<CUSTOMER 1>' THEN 'first' ELSE r END AS result,
           CASE WHEN c_custkey % 10 = 0 THEN '' || c_custkey ELSE '' || c_custkey END AS checked, c_custkey::VARCHAR ~ '^[0-9]+$' AS emptied,
           '+84' || lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 9, '0') AS phone, right('84' || lpad((c_custkey * 7919 % 1000000000)::VARCHAR, 10, '0'), 10) AS local_phone
    FROM t""",
)
def transform_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    key = F.col("c_custkey").cast("string")
    checked = tx.apply_rules_checked(key, [{"type": "trim"}, {"type": "strip", "chars": "0-9"}, {"type": "uppercase"}])
    digits = F.lpad((F.col("c_custkey") * 7919 % 1000000000).cast("string"), 9, "0")
    return c.select(
        "c_custkey",
        tx.apply_rules(F.col("c_name"), RULES).alias("result"),
        checked["result"].alias("checked"),
        (checked["broken_step"] == 1).alias("emptied"),
        tx.format_phone(F.concat(F.lit("0"), digits), "international").alias("phone"),
        tx.format_phone(F.concat(F.lit("+84 0"), digits), "local").alias("local_phone"),
    )


@query(
    "permute_dates",
    """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS european, strftime(o_orderdate, '%m/%d/%Y') AS american, strftime(o_orderdate, '%Y%m%d') AS compact,
              strftime(o_orderdate, '%Y-%m-%d') AS back FROM orders""",
)
def permute_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    european = tx.permute_date(F.col("d"), "yyyy-MM-dd", "dd/MM/yyyy")
    return o.select("o_orderkey", european.alias("european"), tx.permute_date(F.col("d"), "yyyy-MM-dd", "MM/dd/yyyy").alias("american"), tx.permute_date(F.col("d"), "yyyy-MM-dd", "yyyyMMdd").alias("compact"), tx.permute_date(european, "dd/MM/yyyy", "yyyy-MM-dd").alias("back"))


@query(
    "normalize_dates",
    """WITH d AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 6 AS k FROM orders),
    raw AS (SELECT o_orderkey, d, k, CASE k WHEN 0 THEN strftime(d, '%d/%m/%Y') WHEN 1 THEN strftime(d, '%Y-%m-%d') WHEN 2 THEN strftime(d, '%y%m%d') WHEN 3 THEN strftime(d, '%d.%m.%Y') WHEN 4 THEN '99/99/2020' ELSE strftime(d, '%d%m%Y') END AS raw FROM d)
    SELECT o_orderkey, CASE k WHEN 4 THEN raw ELSE strftime(d, '%Y-%m-%d') END AS worker,
           CASE WHEN k = 4 THEN '2020-99-99' WHEN k = 5 THEN CASE WHEN substr(raw, 1, 4)::INT BETWEEN 1900 AND 2100 THEN substr(raw, 1, 4) || '-' || substr(raw, 5, 2) || '-' || substr(raw, 7, 2) END ELSE strftime(d, '%Y-%m-%d') END AS util
    FROM raw""",
)
def normalize_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd")).when(k == 2, F.date_format(d, "yyMMdd")).when(k == 3, F.date_format(d, "dd.MM.yyyy")).when(k == 4, "99/99/2020").otherwise(F.date_format(d, "ddMMyyyy"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return o.select("o_orderkey", dates.normalize_date(F.col("raw")).alias("worker"), dates.normalize_date(F.col("raw"), "util").alias("util"))


@query(
    "expiry_states",
    f"""WITH d AS (SELECT o_orderkey, (o_orderdate + INTERVAL 25 YEAR)::DATE AS e, o_orderdate::DATE AS b FROM orders)
    SELECT CASE WHEN e < DATE '{AS_OF}' THEN 'EXPIRED' WHEN e <= DATE '{AS_OF}' + INTERVAL 3 MONTH THEN 'EXPIRING' ELSE 'VALID' END AS state,
           date_sub('year', b, DATE '{AS_OF}') AS age, count(*) AS n, sum(date_diff('day', DATE '{AS_OF}', e))::BIGINT AS days FROM d GROUP BY ALL""",
)
def expiry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    later = F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 300), "yyyy-MM-dd")
    born = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = o.select(dates.expiry_state(later, AS_OF).alias("state"), dates.age_years(born, AS_OF).cast("long").alias("age"), dates.days_until(later, AS_OF).cast("long").alias("left"))
    return rows.groupBy("state", "age").agg(F.count("*").alias("n"), F.sum("left").alias("days"))


@query(
    "date_rules",
    """SELECT CASE WHEN o_orderdate::DATE >= DATE '2000-01-01' THEN 'NOT_PAST' WHEN o_orderdate::DATE < DATE '1997-01-01' THEN 'TOO_EARLY' ELSE 'OK' END AS broken, count(*) AS n FROM orders GROUP BY ALL""",
)
def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = dates.date_rule(F.date_format("o_orderdate", "yyyy-MM-dd"), "2000-01-01", past=True, least="1997-01-01")
    return table(spark, sf_dir, "orders").groupBy(F.coalesce(broken, F.lit("OK")).alias("broken")).agg(F.count("*").alias("n"))


@query(
    "mask_values",
    """SELECT c_custkey, 'Cust' || repeat('*', length(c_name) - 4) AS name, substr(c_name, 1, 5) || '****' || right(c_name, 1) AS mrz,
              substr(c_name, 1, 2) || '***' || right(c_name, 1) AS middle, 'Ann  ' || 'C' || repeat('*', length(c_name) - 1) AS full_service, 'Ann ' || 'C' || repeat('*', length(c_name) - 1) AS full_worker FROM customer""",
)
def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_name")
    full = F.concat(F.lit("Ann  "), c)
    return table(spark, sf_dir, "customer").select("c_custkey", masks.mask_start(c).alias("name"), masks.mask_mrz(c).alias("mrz"), masks.mask_middle(c).alias("middle"), masks.mask_full_name(full, "service").alias("full_service"), masks.mask_full_name(full).alias("full_worker"))


_R = "***REDACTED***"


@query(
    "strip_sensitive",
    rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\b[A-Z]\d{{8}}\b', '{_R}', 'g'), '\b\d{{9,12}}\b', '{_R}', 'g'), '\b\d{{2}}[/-]\d{{2}}[/-]\d{{4}}\b', '{_R}', 'g'), '\b\d{{4}}\s*\d{{4}}\s*\d{{4}}\s*\d{{4}}\b', '{_R}', 'g') AS text
    FROM documents WHERE regexp_matches(text, '\b[A-Z]\d{{8}}\b|\b\d{{9,12}}\b|\b\d{{2}}[/-]\d{{2}}[/-]\d{{4}}\b|\b\d{{4}}\s*\d{{4}}\s*\d{{4}}\s*\d{{4}}\b')""",
)
def strip_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.where(masks.has_sensitive(F.col("text"))).select("doc_id", masks.strip_sensitive(F.col("text")).alias("text"))


@query(
    "mask_details",
    """SELECT event_id, CASE WHEN length(user_id::VARCHAR) <= 4 THEN '****' ELSE '' END AS user_id, event_type AS kind FROM events""",
)
def mask_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = masks.mask_map(F.create_map(F.lit("userId"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", m["userId"].alias("user_id"), m["kind"].alias("kind"))


_SOUND = "CASE WHEN {u} = '' THEN '000' ELSE rpad(substr({u}, 1, 1) || substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(substr({u}, 2), '[AEIOUHWY]', '', 'g'), 'BFPVCGJKQSXZDTLMNR', '111122222222334556'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g'), 1, 3), 4, '0') END"


@query(
    "soundex_names",
    f"""WITH w AS (SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS u FROM part)
    SELECT {_SOUND.format(u="u")} AS code, count(*) AS n FROM w GROUP BY ALL""",
)
def soundex_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(tx.soundex(F.col("p_name")).alias("code")).agg(F.count("*").alias("n"))


@query(
    "fuzzy_names",
    f"""WITH w AS (SELECT DISTINCT p_name AS a FROM part), pairs AS (SELECT x.a AS a, y.a AS b FROM w x JOIN w y ON split_part(x.a, ' ', 2) = split_part(y.a, ' ', 2)),
    up AS (SELECT a, b, upper(a) AS x, upper(b) AS y, regexp_replace(upper(a), '[^A-Z]', '', 'g') AS ux, regexp_replace(upper(b), '[^A-Z]', '', 'g') AS uy FROM pairs)
    SELECT a, b, round(CASE WHEN x = y THEN 1.0 WHEN {_SOUND.format(u="ux")} = {_SOUND.format(u="uy")} THEN 0.85 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END, 6) AS similarity,
           CASE WHEN x = y THEN 'exact' WHEN {_SOUND.format(u="ux")} = {_SOUND.format(u="uy")} THEN 'soundex' ELSE 'levenshtein' END AS method FROM up""",
)
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names blocked on their last word, so that pairs meet by an equi-join."""
    w = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct().withColumn("block", F.split_part("a", F.lit(" "), F.lit(2)))
    m = tx.fuzzy_match(F.col("a"), F.col("b"))
    return w.join(w.withColumnRenamed("a", "b"), "block").select("a", "b", exact(m["similarity"]).alias("similarity"), m["method"].alias("method"))


@query(
    "ambiguous_characters",
    """WITH c AS (SELECT c_custkey, unnest(range(1, length(c_name) + 1)) AS i, upper(c_name) AS u FROM customer)
    SELECT c_custkey, count(*) AS n, min(i) - 1 AS first_position FROM c WHERE position(substr(u, i, 1) IN '01258OISBZG69') > 0 GROUP BY ALL""",
)
def ambiguous_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tx.ambiguity_warnings(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(w).cast("long").alias("n"), F.array_min(w["position"]).cast("long").alias("first_position")).where("n > 0")


@query("strip_diacritics", "SELECT doc_id, md5(strip_accents(coalesce(text, ''))) AS digest, NULL::VARCHAR AS script FROM documents")
def strip_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.strip_diacritics(F.col("text"))).alias("digest"), tx.non_latin_script(F.col("text")).alias("script"))


@query(
    "infer_document_types",
    """WITH n AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'AB' || lpad(o_orderkey::VARCHAR, 7, '0') WHEN 1 THEN lpad(o_orderkey::VARCHAR, 10, '0') ELSE 'n/a' END AS v, o_orderkey % 3 AS k FROM orders)
    SELECT CASE k WHEN 0 THEN 'PASSPORT' WHEN 1 THEN 'ID_CARD' ELSE 'UNKNOWN' END AS kind, count(*) AS n FROM n GROUP BY ALL""",
)
def infer_document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, k = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 3
    v = F.when(k == 0, F.concat(F.lit("AB"), F.lpad(key, 7, "0"))).when(k == 1, F.lpad(key, 10, "0")).otherwise("n/a")
    return table(spark, sf_dir, "orders").groupBy(tx.infer_document_type(v).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "page_links",
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages) SELECT page_id, count(*) AS n_links, count(DISTINCT target) AS n_targets FROM l GROUP BY ALL""",
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = page_source.elements(table(spark, sf_dir, "pages"), "page_id", "html", "a", "href")
    return links.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_distinct("value").alias("n_targets"))


@query(
    "labelled_lines",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
    SELECT doc_id, arg_min(regexp_extract(line, '^([A-Z][a-zé]+) ([^ ]+)', 2), pos) AS first_value, arg_max(regexp_extract(line, '^([A-Z][a-zé]+) ([^ ]+)', 2), pos) AS last_value
    FROM l WHERE regexp_matches(line, '^[A-Z][a-zé]+ [^ ]+') GROUP BY ALL""",
)
def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text behind a capitalised word at a line's beginning: the first of a document and the last."""
    return page_source.labelled(table(spark, sf_dir, "documents"), "doc_id", "text", r"^([A-Z][a-zé]+) ([^ ]+)", 2)
