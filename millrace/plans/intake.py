"""Queries over lines and fields on their way into guest records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import intake, masks, mrz
from millrace.functions import text as tx
from millrace.operators import windows
from millrace.plans.passports import PASSPORTS_SQL, passport_lines, sql_digit
from millrace.plans.registry import exact, query, table


@query(
    "mrz_best_parse",
    f"""WITH {PASSPORTS_SQL}
    SELECT doc_id, 'TD3' AS format, 33 + CASE WHEN doc_id % 3 = 2 THEN 0 ELSE 3 END + CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 20 END AS score,
           substr(line2, 1, 9) AS number, country AS nationality FROM passports""",
)
def mrz_best_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parses a row; a damaged number takes the bonus of valid digits from all of them."""
    p = windows.materialised(passport_lines(spark, sf_dir), "best", intake.best_parse(F.col("line1"), F.col("line2"), F.lit(None)))
    return p.select("doc_id", "best.format", "best.score", F.col("best.fields.passport_number").alias("number"), "best.fields.nationality")


@query(
    "mrz_formats",
    f"""WITH made AS (SELECT c_custkey AS doc_id, c_custkey % 2 = 0 AS small, 'N' || lpad(c_custkey::VARCHAR, 8, '0') AS number,
                             strftime(DATE '1950-01-01' + (c_custkey * 37 % 20000)::INT, '%y%m%d') AS dob, strftime(DATE '2020-01-01' + (c_custkey * 53 % 3600)::INT, '%y%m%d') AS exp FROM customer),
    seen AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN regexp_replace(dob, '1', 'I') ELSE dob END AS shown, {sql_digit("dob")} AS digit FROM made),
    tried AS (SELECT *, i, substr(shown, 1, i - 1) || translate(substr(shown, i, 1), 'OIBSZ01852', '01852OIBSZ') || substr(shown, i + 1) AS candidate FROM seen, range(1, 7) AS t(i)),
    summed AS (SELECT *, {sql_digit("shown")} = digit AS holds, {sql_digit("candidate")} = digit AND candidate <> shown AS mends FROM tried),
    chosen AS (SELECT doc_id, small, number, exp, holds, coalesce(CASE WHEN NOT holds THEN arg_min(candidate, i) FILTER (mends) END, any_value(shown)) AS dob,
                      CASE WHEN NOT holds AND bool_or(mends) THEN 'date_of_birth' ELSE '' END AS repaired FROM summed GROUP BY doc_id, small, number, exp, holds)
    SELECT doc_id, CASE WHEN small THEN 'TD1' ELSE 'TD2' END AS format, number, repaired,
           coalesce(strftime(CASE WHEN regexp_matches(dob, '^[0-9]{{6}}$') THEN try_strptime(dob, '%y%m%d') END, '%Y-%m-%d'), '') AS date_of_birth, strftime(strptime(exp, '%y%m%d'), '%Y-%m-%d') AS expiry_date FROM chosen""",
)
def mrz_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of two and three lines; in every fifth the first 1 of the birth date was read as I, which the first substitution that fits may mend wrongly."""
    key = F.col("c_custkey")

    def date(start: str, step: int, span: int) -> F.Column:
        return F.date_format(F.date_add(F.lit(start).cast("date"), (key * step % span).cast("int")), "yyMMdd")

    c = table(spark, sf_dir, "customer").select(key.alias("doc_id"), F.concat(F.lit("N"), F.lpad(key.cast("string"), 8, "0")).alias("number"), date("1950-01-01", 37, 20000).alias("dob"), date("2020-01-01", 53, 3600).alias("exp"))
    small = F.col("doc_id") % 2 == 0
    at = F.locate("1", "dob")
    shown = F.when((F.col("doc_id") % 5 == 0) & (at > 0), F.concat(F.substring(F.col("dob"), F.lit(1), at - 1), F.lit("I"), F.substring(F.col("dob"), at + 1, F.lit(6)))).otherwise(F.col("dob"))
    line2 = F.concat("number", mrz.check_digit(F.col("number")), F.lit("VNM"), shown, mrz.check_digit(F.col("dob")), F.lit("F"), "exp", mrz.check_digit(F.col("exp")))
    width = F.when(small, 30).otherwise(36)
    lines = c.select("doc_id", F.rpad(F.lit("I<VNMNGUYEN<<THI"), width, "<").alias("line1"), F.rpad(line2, width, "<").alias("line2"), F.when(small, F.lit("<" * 30)).alias("line3"))
    lines = windows.materialised(lines, "fix", mrz.repair_line2(F.col("line2"))).withColumn("fmt", mrz.line_format(F.col("line1"), F.col("fix.line2"), F.col("line3")))
    f = windows.materialised(lines, "f", mrz.parse(F.col("line1"), F.col("fix.line2"), F.col("line3"), F.col("fmt")))
    return f.select("doc_id", F.col("fmt").alias("format"), F.col("f.passport_number").alias("number"), F.array_join("fix.repaired", ";").alias("repaired"), "f.date_of_birth", "f.expiry_date")


_SWAPPED = " || ".join(f"CASE WHEN (m >> {i}) & 1 = 1 THEN translate(substr(shown, {i + 1}, 1), 'OIBSZ01852', '01852OIBSZ') ELSE substr(shown, {i + 1}, 1) END" for i in range(9))


@query(
    "mrz_best_substitution_value",
    f"""WITH {PASSPORTS_SQL}, shown AS (SELECT doc_id, substr(line2, 1, 9) AS shown, substr(line2, 10, 1) AS digit FROM passports),
    made_up AS (SELECT DISTINCT doc_id, shown, digit, {_SWAPPED} AS candidate FROM shown, range(512) AS t(m)),
    summed AS (SELECT doc_id, shown, digit, candidate, {sql_digit("candidate")} AS own FROM made_up)
    SELECT doc_id, coalesce(max(candidate) FILTER (own = digit AND candidate = shown), min(candidate) FILTER (own = digit), any_value(shown)) AS value FROM summed GROUP BY doc_id""",
)
def mrz_best_substitution_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text itself; SQL makes all candidates."""
    p = passport_lines(spark, sf_dir)
    return p.select("doc_id", mrz.best_substitution(F.substring("line2", 1, 9), F.substring("line2", 10, 1)).alias("value"))


@query(
    "candidate_choice",
    f"""WITH {PASSPORTS_SQL},
    tried AS (SELECT doc_id, doc_id % 7 = 0 AS bad, unnest(['whole', 'short', 'one line', 'noisy']) AS way FROM passports),
    worth AS (SELECT doc_id, way, CASE way
        WHEN 'whole' THEN 20 + 80 + 80 + 10 + 200 + CASE WHEN bad THEN 0 ELSE 300 END + 20 + 25
        WHEN 'short' THEN 20 + 80 + 70 + 10 + 200 + CASE WHEN bad THEN 0 ELSE 100 END + 20 + 45
        WHEN 'one line' THEN 20 + 40 + 10 - 100 + 50
        ELSE 20 + 80 + 80 + 10 + 200 + CASE WHEN bad THEN 0 ELSE 300 END + 20 + 25 - 50 END::DOUBLE AS score FROM tried)
    SELECT doc_id, way, score FROM worth QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, way) <= 2""",
)
def candidate_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best of four candidates a document: whole lines, lines cut to 36, one line alone, and whole lines with a third of stray characters."""
    p = passport_lines(spark, sf_dir)
    l1, l2, none = F.col("line1"), F.col("line2"), F.lit(None).cast("string")

    def way(name: str, a: F.Column, b: F.Column, lines: F.Column, confidence: float) -> F.Column:
        return F.struct(F.lit(name).alias("way"), a.alias("a"), b.alias("b"), lines.alias("lines"), F.lit(confidence).alias("confidence"))

    cut = [F.substring(line, 1, 36) for line in (l1, l2)]
    ways = F.array(way("whole", l1, l2, F.array(l1, l2), 0.5), way("short", *cut, F.array(*cut), 0.9), way("one line", l1, none, F.array(l1), 1.0), way("noisy", l1, l2, F.array(l1, l2, F.lit("?" * 11)), 0.5))
    each = p.select("doc_id", F.explode(ways).alias("c")).select("doc_id", "c.*")
    scored = each.select("doc_id", "way", intake.candidate_score(F.col("lines"), F.col("a"), F.col("b"), F.col("confidence")).alias("score"))
    return windows.best(scored, ["doc_id"], "score", ["way"], 2)


@query(
    "card_fields",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'X' || c_custkey ELSE c_custkey::VARCHAR END AS id_number, upper(c_name) AS full_name,
              CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '01/02/19' || lpad((c_custkey % 100)::VARCHAR, 2, '0') END AS date_of_birth, CASE WHEN c_custkey % 5 = 0 THEN 'UNKNOWN' ELSE 'F' END AS gender,
              'KOREAN' AS nationality, '2020-01-05' AS issue_date, '2030.01.05' AS expiry_date FROM customer""",
)
def card_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    k = F.col("c_custkey")
    born = F.when(k % 3 != 0, F.concat(F.lit("DOB: 01/02/19"), F.lpad((k % 100).cast("string"), 2, "0")))
    lines = F.array_compact(F.array(F.lit("REPUBLIC"), F.concat(F.lit(" id no: "), key), F.concat(F.lit("Full name: "), F.col("c_name")), born, F.when(k % 5 != 0, F.lit("Sex . F")), F.lit("Nationality Korean"), F.lit("Date of issue 2020-01-05"), F.lit("expires: 2030.01.05"), F.when(k % 4 == 0, F.concat(F.lit("citizen id #X"), key))))
    f = table(spark, sf_dir, "customer").select(k, F.array_join(lines, "\n").alias("raw"))
    return windows.materialised(f, "f", intake.card_fields(F.col("raw"))).select("c_custkey", "f.*")


@query(
    "guest_records",
    """WITH k AS (SELECT c_custkey, c_custkey % 4 AS way, upper(c_name) AS name FROM customer)
    SELECT 'R' || c_custkey AS row_id, CASE WHEN way = 3 THEN '' ELSE name END AS full_name, CASE WHEN way < 2 THEN 'P' || c_custkey ELSE '' END AS passport_number,
           CASE WHEN way = 2 THEN 'ID' || c_custkey ELSE '' END AS id_number, CASE way WHEN 0 THEN 'VNM' WHEN 1 THEN 'USA' WHEN 2 THEN 'FRA' ELSE '' END AS nationality,
           CASE way WHEN 0 THEN '1975-01-01' WHEN 1 THEN '' WHEN 2 THEN '1980-02-01' ELSE '' END AS date_of_birth, CASE way WHEN 0 THEN 'M' WHEN 2 THEN 'F' ELSE 'UNKNOWN' END AS gender,
           CASE WHEN way = 0 THEN 'VNM' ELSE '' END AS issuing_country, CASE way WHEN 2 THEN 'ID_CARD' WHEN 3 THEN 'UNKNOWN' ELSE 'PASSPORT' END AS document_type, 'f' || c_custkey AS source_file,
           'mrz_main_' || CASE WHEN way = 0 THEN 'found' ELSE 'not_found' END AS selected_candidate, 24 AS n_columns FROM k""",
)
def guest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from the first source that is there, whole, and their diagnostic rows: a visual reading behind a zone fills none of its gaps."""
    k = F.col("c_custkey")
    key, way = k.cast("string"), k % 4

    def fields(condition: F.Column, **values) -> F.Column:
        pairs = [x for name, v in values.items() for x in (F.lit(name), v if isinstance(v, F.Column) else F.lit(v))]
        return F.when(condition, F.create_map(*pairs))

    name = F.lower("c_name")
    found = {
        "mrz": fields(way == 0, full_name=name, passport_number=F.concat(F.lit(" p"), key, F.lit("<<")), nationality="VN", date_of_birth="750101", gender="nam", issuing_country="VNM"),
        "visual": fields(way < 2, full_name=name, passport_number=F.concat(F.lit("P"), key), nationality="US", surname="SEEN"),
        "card": fields(way == 2, full_name=name, id_number=F.concat(F.lit("id"), key), nationality="FRA", date_of_birth="01/02/1980", gender="f"),
    }
    c = table(spark, sf_dir, "customer").select(k, F.concat(F.lit("R"), key).alias("row"), F.concat(F.lit("f"), key).alias("file"), *[v.alias(s) for s, v in found.items()])
    r = windows.materialised(c, "record", intake.guest_record(F.col("row"), F.col("file"), {s: F.col(s) for s in found}))
    quality = F.struct(*[F.lit(1.0).alias(n) for n in ("width", "height", "blur_score", "brightness", "contrast")])
    d = intake.diagnostic(F.col("record"), quality, F.lit("main"), F.col("mrz").isNotNull(), F.lit(0.5), F.array(F.lit("")), F.lit(1))
    shown = ["row_id", "full_name", "passport_number", "id_number", "nationality", "date_of_birth", "gender", "issuing_country", "document_type", "source_file"]
    width = len(r.schema["record"].dataType.fields)
    return r.select(*[f"record.{n}" for n in shown], d["selected_candidate"].alias("selected_candidate"), F.lit(width).alias("n_columns"))


@query(
    "warning_lists",
    """SELECT o_orderkey, concat_ws(';', CASE WHEN o_orderkey % 2 = 0 THEN 'ENGINE_SLOW' END, CASE WHEN o_orderkey % 3 < 2 THEN 'MRZ_NOT_FOUND' END,
              CASE WHEN o_orderkey % 5 = 0 THEN 'DOB_CHECK_FAILED;FINAL_CHECK_FAILED' END, CASE WHEN o_orderkey % 7 = 0 THEN 'DOB_MISSING' END, CASE WHEN o_orderkey % 7 < 2 THEN 'DOB_MISSING' END,
              CASE WHEN o_orderkey % 11 = 0 THEN 'VISUAL_OCR_USED' END, CASE WHEN o_totalprice > 200000 THEN 'BLURRY' END) AS warnings FROM orders""",
)
def warning_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")

    def some(condition: F.Column, *names: str) -> F.Column:
        return F.when(condition, F.array(*map(F.lit, names)))

    w = intake.collect_warnings(some(k % 2 == 0, "ENGINE_SLOW"), (k % 3).cast("int"), some(k % 5 == 0, "DATE_OF_BIRTH_CHECK_FAILED", "OPTIONAL_DATA_CHECK_FAILED", "COMPOSITE_CHECK_FAILED"), some(k % 7 == 0, "DOB_MISSING"), some(k % 7 < 2, "DOB_MISSING"), k % 11 == 0, some(F.col("o_totalprice") > 200000, "BLURRY"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(w, ";").alias("warnings"))


@query(
    "fill_readiness",
    """SELECT o_orderkey, o_orderkey % 3 = 0 AS needs_review, CASE WHEN o_orderkey % 3 = 0 THEN 'gender;note' ELSE '' END AS to_review,
              o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 AS ready,
              round(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE least(1.0, (1 + 0.8 + 0.5 * (o_orderkey % 10) / 10 + 0.05 * (1 + (o_orderkey % 2))) / (3 + 0.05 * (1 + (o_orderkey % 2)))) END, 6)::DOUBLE AS confidence FROM orders""",
)
def fill_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readiness by six required fields, of which odd orders lack one, and confidence by where fields were read."""
    k = F.col("o_orderkey")

    def result(name: str, valid: F.Column, review: F.Column) -> F.Column:
        return F.struct(F.lit(name).alias("field"), valid.alias("valid"), review.alias("needs_review"))

    yes, no = F.lit(True), F.lit(False)
    parts = [result(n, yes, no) for n in intake.REQUIRED[:4]] + [result("gender", k % 5 != 0, k % 3 == 0), result("note", no, k % 3 == 0)]
    results = F.concat(F.array(*parts), F.when(k % 2 == 0, F.array(result("nationality", yes, no))).otherwise(F.array().cast("array<struct<field:string,valid:boolean,needs_review:boolean>>")))

    def read(source: str, confidence: F.Column) -> F.Column:
        return F.struct(F.lit(source).alias("source"), confidence.alias("confidence"))

    resolved = F.array(read("mrz", F.lit(0.4)), read("mrz_repaired", F.lit(0.4)), read("visual_ocr", (k % 10) / F.lit(10.0)))
    resolved = F.when(k % 7 == 0, F.slice(resolved, 1, 0)).otherwise(resolved)
    checks = F.create_map(F.lit("a"), yes, F.lit("b"), k % 2 == 1, F.lit("c"), no)
    t = table(spark, sf_dir, "orders").select(k, results.alias("results"), resolved.alias("resolved"), checks.alias("checks"))
    return t.select("o_orderkey", intake.needs_review(F.col("results")).alias("needs_review"), F.array_join(intake.fields_for_review(F.col("results")), ";").alias("to_review"), intake.is_ready(F.col("results")).alias("ready"), exact(intake.visual_confidence(F.col("resolved"), F.col("checks"))).alias("confidence"))


@query(
    "prefill_checks",
    """SELECT c_custkey, concat_ws(';', CASE WHEN c_custkey % 4 = 0 THEN 'name EMPTY_VALUE' END, CASE WHEN c_custkey % 3 = 0 THEN 'date_of_birth INVALID_FORMAT' END,
              CASE WHEN c_custkey % 5 = 1 THEN 'Gender INVALID_FORMAT' END, CASE WHEN c_custkey % 7 = 0 THEN 'room SAFETY_RULE_BLOCKED' END) AS errors,
              NOT (c_custkey % 4 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 1 OR c_custkey % 7 = 0) AS valid FROM customer""",
)
def prefill_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    values = F.create_map(
        F.lit("name"), F.when(k % 4 == 0, F.lit("  ")).otherwise(F.col("c_name")),
        F.lit("date_of_birth"), F.when(k % 3 == 0, F.lit("1/2/1980")).otherwise(F.lit(" 1980-02-01 ")),
        F.lit("Gender"), F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit("male")).otherwise(F.lit("x")),
        F.lit("room"), F.when(k % 7 != 0, F.lit("12")),
    )

    def mapping(name: str, required: bool, enabled: bool = True) -> F.Column:
        return F.struct(F.lit(name).alias("form_field"), F.lit(required).alias("required"), F.lit(enabled).alias("enabled"))

    def rule(kind: str, name: str) -> F.Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(name).alias("field"))

    mappings = F.array(mapping("name", True), mapping("date_of_birth", False), mapping("Gender", False), mapping("absent", True, False))
    rules = F.array(rule("field_exists", "room"), rule("no_popup", "room"), rule("field_exists", ""))
    errors = intake.prefill_errors(F.col("values"), mappings, rules)
    t = table(spark, sf_dir, "customer").select(k, values.alias("values"))
    return windows.materialised(t, "errors", errors).select("c_custkey", F.array_join(F.transform("errors", lambda e: F.concat_ws(" ", e["field"], e["code"])), ";").alias("errors"), (F.size("errors") == 0).alias("valid"))


@query(
    "masked_short_texts",
    """WITH t AS (SELECT n_nationkey, substr(n_name || n_name, 1, (n_nationkey % 13)::INT) AS v FROM nation)
    SELECT n_nationkey, CASE WHEN length(v) <= 5 THEN v WHEN length(v) <= 10 THEN substr(v, 1, 5) || '*****' ELSE substr(v, 1, 5) || '****' || right(v, 1) END AS zone, CASE WHEN length(v) <= 4 THEN '****' ELSE substr(v, 1, 2) || '***' || right(v, 1) END AS middle FROM t""",
)
def masked_short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    t = table(spark, sf_dir, "nation").select(n, F.substring(F.concat("n_name", "n_name"), F.lit(1), (n % 13).cast("int")).alias("v"))
    return t.select("n_nationkey", masks.mask_mrz(F.col("v")).alias("zone"), masks.mask_middle(F.col("v")).alias("middle"))


#: Test data: a name in Vietnamese, Cyrillic, Greek, Arabic and Latin letters, what it is in plain Latin ones, its script, and how sure that is.
NAMES = (
    ("Nguyễn Thị Hạnh", "Nguyen Thi Hanh", "NGUYỄN THỊ HẠNH", None, 1.0),
    ("Иван Щукин", "Иван Щукин", "IVAN SHCHUKIN", "CYRILLIC", 0.8),
    ("Νικος", "Νικος", "NIKOS", "GREEK", 0.8),
    ("محمد", "محمد", "محمد", "ARABIC", 0.7),
    ("José Müller", "Jose Muller", "JOSÉ MÜLLER", None, 1.0),
)


@query(
    "scripts_of_names",
    "WITH n(k, stripped, latin, script, sure) AS (VALUES " + ", ".join(f"({k}, '{s}', '{t}', {'NULL' if c is None else repr(c)}, {p})" for k, (_, s, t, c, p) in enumerate(NAMES)) + f""")
    SELECT c_custkey, stripped, latin, script, sure::DOUBLE AS sure FROM customer JOIN n ON c_custkey % {len(NAMES)} = k""",
)
def scripts_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.element_at(F.array(*[F.lit(n) for n, *_ in NAMES]), (F.col("c_custkey") % len(NAMES) + 1).cast("int"))
    t = table(spark, sf_dir, "customer").select("c_custkey", v.alias("v"))
    return t.select("c_custkey", tx.strip_diacritics(F.col("v")).alias("stripped"), tx.transliterate(F.col("v")).alias("latin"), tx.non_latin_script(F.col("v")).alias("script"), tx.transliteration_confidence(F.col("v")).alias("sure"))
