"""Passport lines made from customers, every seventh with a confused character, and the queries that decode them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import mrz, rules
from millrace.operators import windows
from millrace.plans.registry import AS_OF, exact, query, spread, table

COUNTRIES = ["VNM", "USA", "KOR", "CHN", "JPN", "FRA", "DEU", "GBR", "ITA", "ESP"]


def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written on each customer's passport, with the digits of number and dates; segment is the customer's own."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey")
    key = F.col("c_custkey")
    number = F.concat(F.lit("P"), F.lpad(key.cast("string"), 8, "0"))
    country = F.element_at(F.array(*map(F.lit, COUNTRIES)), (F.col("c_nationkey") % 10 + 1).cast("int"))
    names = F.replace(F.upper("c_name"), F.lit("#"), F.lit("<<"))

    def date(start: str, step: int, span: int) -> Column:
        return F.date_format(F.date_add(F.lit(start).cast("date"), (key * step % span).cast("int")), "yyMMdd")

    d = c.select(key.alias("doc_id"), country.alias("country"), number.alias("true_number"), names.alias("names"), date("1950-01-01", 37, 20000).alias("dob"), date("2020-01-01", 53, 3600).alias("exp"), F.element_at(F.array(F.lit("M"), F.lit("F"), F.lit("<")), (key % 3 + 1).cast("int")).alias("sex"), F.upper("c_mktsegment").alias("segment"))
    return d.withColumns({"n1": mrz.check_digit(F.col("true_number")), "d1": mrz.check_digit(F.col("dob")), "e1": mrz.check_digit(F.col("exp"))})


def passport_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, country, line1, line2, true_number."""
    d = holders(spark, sf_dir)
    whole = mrz.check_digit(F.concat("true_number", "n1", "dob", "d1", "exp", "e1", F.lit("<" * 14 + "0")))
    shown = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("PO"), F.substring("true_number", 3, 7))).otherwise(F.col("true_number"))
    line1 = F.rpad(F.concat(F.lit("P<"), F.col("country"), F.col("names")), 44, "<")
    line2 = F.concat(shown, F.col("n1"), F.col("country"), F.col("dob"), F.col("d1"), F.col("sex"), F.col("exp"), F.col("e1"), F.lit("<" * 14 + "0"), whole)
    return d.select("doc_id", "country", line1.alias("line1"), line2.alias("line2"), "true_number")


def sql_digit(v: str) -> str:
    return f"(list_sum(list_transform(range(1, length({v}) + 1), lambda i: CASE WHEN substr({v}, i, 1) = '<' THEN 0 ELSE position(substr({v}, i, 1) IN '{mrz.ALPHABET}') - 1 END * CASE i % 3 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 1 END)) % 10)::VARCHAR"


_COUNTRY = "['" + "','".join(COUNTRIES) + "'][(c_nationkey % 10) + 1]"
PASSPORTS_SQL = f"""
    made AS (SELECT c_custkey AS doc_id, {_COUNTRY} AS country, 'P' || lpad(c_custkey::VARCHAR, 8, '0') AS true_number,
                    replace(upper(c_name), '#', '<<') AS names,
                    strftime(DATE '1950-01-01' + (c_custkey * 37 % 20000)::INT, '%y%m%d') AS dob,
                    strftime(DATE '2020-01-01' + (c_custkey * 53 % 3600)::INT, '%y%m%d') AS exp,
                    ['M', 'F', '<'][(c_custkey % 3) + 1] AS sex FROM customer),
    digits AS (SELECT *, {sql_digit("true_number")} AS n1, {sql_digit("dob")} AS d1, {sql_digit("exp")} AS e1 FROM made),
    covered AS (SELECT *, true_number || n1 || dob || d1 || exp || e1 || '<<<<<<<<<<<<<<0' AS part FROM digits),
    passports AS (SELECT doc_id, country, true_number, rpad('P<' || country || names, 44, '<') AS line1,
                         CASE WHEN doc_id % 7 = 0 THEN 'PO' || substr(true_number, 3) ELSE true_number END || n1 || country || dob || d1 || sex || exp || e1 || '<<<<<<<<<<<<<<0' || {sql_digit("part")} AS line2
                  FROM covered)"""


def _date_sql(v: str, pivot: int) -> str:
    return f"CASE WHEN substr({v}, 1, 2)::INT <= {pivot} THEN '20' ELSE '19' END || substr({v}, 1, 2) || '-' || substr({v}, 3, 2) || '-' || substr({v}, 5, 2)"


def _posix_date_sql(v: str) -> str:
    """Two-digit years as POSIX reads them: 69 to 99 are of the last century."""
    return f"strftime(strptime({v}, '%y%m%d'), '%Y-%m-%d')"


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines repaired, checked and parsed."""
    p = windows.materialised(passport_lines(spark, sf_dir), "fmt", mrz.line_format(F.col("line1"), F.col("line2"), F.lit("")))
    p = windows.materialised(p, "fix", F.struct(mrz.validate(F.col("line2"), F.col("fmt")).alias("before"), mrz.repair_line2(F.col("line2")).alias("fix")))
    p = p.select("doc_id", "country", "line1", "line2", "true_number", "fmt", "fix.before", "fix.fix").withColumn("fixed", F.col("fix.line2"))
    p = windows.materialised(p, "checks", mrz.validate(F.col("fixed"), F.col("fmt")))
    return windows.materialised(p, "fields", mrz.parse(F.col("line1"), F.col("fixed"), F.lit(""), F.col("fmt")))


@query(
    "mrz_decode",
    f"""WITH {PASSPORTS_SQL},
    scored AS (SELECT doc_id, country, {sql_digit("substr(line2, 1, 9)")} = substr(line2, 10, 1) AS ok FROM passports)
    SELECT country, CASE WHEN ok THEN 'HIGH' ELSE 'MEDIUM' END AS level, count(*) AS n, count(*) FILTER (NOT ok) AS repaired,
           round(avg(CASE WHEN ok THEN 1.0 ELSE 0.75 END), 4) AS mean_score
    FROM scored GROUP BY ALL""",
)
def mrz_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: detect, repair, validate, score and summarise by country and level; a repaired number was read from the visual zone too."""
    d = decoded(spark, sf_dir)
    repaired = F.size("fix.repaired") > 0
    complete = (F.col("fields.full_name") != "") & (F.col("fields.passport_number") != "")
    yes = F.lit(True)
    score = rules.passport_confidence(yes, F.col("fmt") == "TD3", {k: F.col(f"checks.{k}") for k in ("passport_number", "date_of_birth", "expiry_date", "composite")}, complete, F.size("before.errors"), yes, yes, repaired, repaired)
    scored = d.select("country", score.alias("score"), repaired.alias("fixed"))
    return scored.groupBy("country", rules.level(F.col("score")).alias("level")).agg(F.count("*").alias("n"), F.count_if("fixed").alias("repaired"), exact(F.avg("score"), 4).alias("mean_score"))


@query("mrz_check_digits", f"WITH {PASSPORTS_SQL} SELECT doc_id, {sql_digit('substr(line2, 1, 9)')} AS number_digit, {sql_digit('substr(line2, 14, 6)')} AS birth_digit, {sql_digit('line1')} AS line_digit FROM passports")
def mrz_check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passport_lines(spark, sf_dir)
    return p.select("doc_id", mrz.check_digit(F.substring("line2", 1, 9)).alias("number_digit"), mrz.check_digit(F.substring("line2", 14, 6)).alias("birth_digit"), mrz.check_digit(F.col("line1")).alias("line_digit"))


@query(
    "mrz_parse",
    f"""WITH {PASSPORTS_SQL}
    SELECT doc_id, country AS issuing_country, 'CUSTOMER' AS surname, split_part(rtrim(substr(line1, 6), '<'), '<<', 2) AS given_names,
           substr(line2, 11, 3) AS nationality, rtrim(substr(line2, 1, 9), '<') AS number,
           {_posix_date_sql("substr(line2, 14, 6)")} AS date_of_birth, {_posix_date_sql("substr(line2, 22, 6)")} AS expiry_date,
           {_date_sql("substr(line2, 14, 6)", 49)} AS birth_pivot_49,
           CASE WHEN substr(line2, 21, 1) IN ('M', 'F') THEN substr(line2, 21, 1) ELSE 'UNKNOWN' END AS sex FROM passports""",
)
def mrz_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passport_lines(spark, sf_dir)
    f = mrz.parse(F.col("line1"), F.col("line2"), F.lit(""), mrz.line_format(F.col("line1"), F.col("line2"), F.lit("")))
    late = mrz.mrz_date(mrz.at(F.col("line2"), 13, 6), 49, strict=False)
    return p.withColumn("f", f).select("doc_id", "f.issuing_country", "f.surname", "f.given_names", "f.nationality", F.col("f.passport_number").alias("number"), "f.date_of_birth", "f.expiry_date", late.alias("birth_pivot_49"), "f.sex")


@query(
    "mrz_repair",
    f"""WITH {PASSPORTS_SQL}
    SELECT doc_id, true_number || substr(line2, 10) AS line2, CASE WHEN doc_id % 7 = 0 THEN 'passport_number' ELSE '' END AS repaired,
           CASE WHEN doc_id % 7 = 0 THEN 'PASSPORT_NUMBER_CHECK_FAILED;COMPOSITE_CHECK_FAILED' ELSE '' END AS errors_before, true AS valid_after
    FROM passports""",
)
def mrz_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decoded(spark, sf_dir)
    return d.select("doc_id", F.col("fixed").alias("line2"), F.array_join("fix.repaired", ";").alias("repaired"), F.array_join("before.errors", ";").alias("errors_before"), (F.size("checks.errors") == 0).alias("valid_after"))


@query(
    "mrz_all_substitutions",
    f"""WITH {PASSPORTS_SQL}
    SELECT doc_id, 2 ** length(regexp_replace(substr(true_number, 6), '[^0158OIBSZ2]', '', 'g')) AS n_candidates FROM passports""",
)
def mrz_all_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subset of confusable characters in the number's last four places."""
    p = passport_lines(spark, sf_dir)
    return p.select("doc_id", F.size(mrz.all_substitutions(F.substring("true_number", 6, 4))).cast("double").alias("n_candidates"))


_CANDIDATE = " || ".join(f"CASE WHEN (m >> {i}) & 1 = 1 THEN translate(substr(true_number, {i + 1}, 1), 'OIBSZ01852', '01852OIBSZ') ELSE substr(true_number, {i + 1}, 1) END" for i in range(9))


@query(
    "mrz_all_substitutions_whole",
    f"""WITH {PASSPORTS_SQL}, made_up AS (SELECT DISTINCT doc_id, {_CANDIDATE} AS candidate FROM passports, range(512) AS t(m))
    SELECT doc_id, count(*) AS n_candidates, sha256(string_agg(candidate, ',' ORDER BY candidate)) AS candidates_sha256 FROM made_up GROUP BY doc_id""",
)
def mrz_all_substitutions_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subset of confusable characters in the whole number, by count and digest of the ordered candidates."""
    p = passport_lines(spark, sf_dir).withColumn("made_up", mrz.all_substitutions(F.col("true_number")))
    return p.select("doc_id", F.size("made_up").cast("long").alias("n_candidates"), F.sha2(F.array_join("made_up", ","), 256).alias("candidates_sha256"))


@query("mrz_best_substitution", f"WITH {PASSPORTS_SQL} SELECT doc_id, {sql_digit('true_number')} = {sql_digit('true_number')} AS digit_holds FROM passports")
def mrz_best_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passport_lines(spark, sf_dir)
    best = mrz.best_substitution(F.substring("line2", 1, 9), F.substring("line2", 10, 1))
    return p.select("doc_id", (mrz.check_digit(best, "service") == F.substring("line2", 10, 1)).alias("digit_holds"))


@query(
    "mrz_line_pairs",
    f"""WITH {PASSPORTS_SQL}, lens AS (SELECT *, length(line1) AS a, length(line2) AS b FROM passports)
    SELECT doc_id, (40.0 + 40.0 + 20.0 + CASE WHEN substr(line1, 3, 1) IN ('<', 'A', 'V') THEN 5.0 ELSE 0 END
           + CASE WHEN regexp_matches(line2, '[0-9]{{6}}') THEN 10.0 ELSE 0 END
           + CASE WHEN length(line1) - length(replace(line1, '<', '')) >= 5 THEN 5.0 ELSE 0 END + CASE WHEN length(line2) - length(replace(line2, '<', '')) >= 5 THEN 5.0 ELSE 0 END)::DOUBLE AS score,
           list_max(list_transform(regexp_extract_all(line1, '<+'), lambda x: length(x))) AS longest_run
    FROM lens""",
)
def mrz_line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = passport_lines(spark, sf_dir)
    return p.select("doc_id", mrz.line_pair_score(F.col("line1"), F.col("line2")).alias("score"), mrz.longest_filler_run(F.col("line1")).cast("long").alias("longest_run"))


@query(
    "mrz_find_lines",
    """WITH lines AS (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_replace(upper(replace(s, 'ß', 'ss')), '[^A-Z0-9<]', '', 'g'))) AS line FROM documents)
    SELECT doc_id, count(*) AS n_lines, count(*) >= 2 AS has_pattern FROM lines WHERE length(line) >= 20 GROUP BY doc_id""",
)
def mrz_find_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.materialised(table(spark, sf_dir, "documents").select("doc_id", "text"), "n_lines", mrz.count_mrz_lines(F.col("text")).cast("long"))
    return d.where("n_lines > 0").select("doc_id", "n_lines", (F.col("n_lines") >= 2).alias("has_pattern"))


@query(
    "passport_warnings",
    f"""WITH {PASSPORTS_SQL}, d AS (SELECT doc_id, date_diff('day', DATE '{AS_OF}', ({_posix_date_sql("substr(line2, 22, 6)")})::DATE) AS left_days FROM passports)
    SELECT doc_id, CASE WHEN left_days < 0 THEN 'PASSPORT_EXPIRED' WHEN left_days <= 90 THEN 'PASSPORT_EXPIRING_SOON' ELSE '' END AS warnings FROM d""",
)
def passport_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = decoded(spark, sf_dir).select("doc_id", "fields.*")
    w = rules.passport_warnings(F.col("full_name"), F.col("passport_number"), F.col("date_of_birth"), F.col("expiry_date"), AS_OF)
    return f.select("doc_id", F.array_join(w, ";").alias("warnings"))


@query(
    "cross_field_issues",
    f"""WITH {PASSPORTS_SQL}, d AS (SELECT doc_id, ({_posix_date_sql("substr(line2, 14, 6)")})::DATE AS b, ({_posix_date_sql("substr(line2, 22, 6)")})::DATE AS e FROM passports),
    y AS (SELECT doc_id, b, e, date_diff('day', b, e) / 365.25 AS years FROM d)
    SELECT doc_id, concat_ws(';', CASE WHEN e <= b THEN 'EXPIRY_BEFORE_BIRTH' END, CASE WHEN years > 0 AND (years < 15 OR years > 100) THEN 'IMPLAUSIBLE_VALIDITY' END) AS issues FROM y""",
)
def cross_field_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = decoded(spark, sf_dir).select("doc_id", "fields.*")
    issues = rules.cross_field_issues(F.col("issuing_country"), F.col("nationality"), F.col("date_of_birth"), F.col("expiry_date"), F.col("full_name"), F.col("surname"))
    return f.select("doc_id", F.array_join(issues, ";").alias("issues"))
