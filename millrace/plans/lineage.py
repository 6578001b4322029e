"""Zones in three formats with damage in numbers, dates, codes and names, read by the repairing parser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import lineage, mrz
from millrace.plans.passports import PASSPORTS_SQL, holders
from millrace.plans.registry import query

_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digit(v: str) -> str:
    return f"(list_sum(list_transform(range(1, length({v}) + 1), lambda p: greatest(position(substr({v}, p, 1) IN '{_ALPHABET}') - 1, 0) * CASE p % 3 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 1 END)) % 10)::VARCHAR"


def _tried(v: str, width: int, swaps: tuple[str, str]) -> str:
    """All subsets of swaps of v, in order."""
    letter = "CASE WHEN (m >> {k}) & 1 = 1 THEN translate(substr({v}, {j}, 1), '{a}', '{b}') ELSE substr({v}, {j}, 1) END"
    whole = " || ".join(letter.format(k=k, j=k + 1, v=v, a=swaps[0], b=swaps[1]) for k in range(width))
    return f"list_sort(list_distinct(list_transform(range({1 << width}), lambda m: {whole})))"


_NUMBER, _DATE = ("O0I1", "0O1I"), ("O0I1LZSBG", "0O1I12586")
_READS = "regexp_full_match({0}, '[0-9]{{6}}') AND substr({0}, 3, 2) BETWEEN '01' AND '12' AND substr({0}, 5, 2) BETWEEN '01' AND '31'"


def _iso(v: str) -> str:
    return f"CASE WHEN {_READS.format(v)} THEN CASE WHEN substr({v}, 1, 2) <= '49' THEN '20' ELSE '19' END || substr({v}, 1, 2) || '-' || substr({v}, 3, 2) || '-' || substr({v}, 5, 2) ELSE '' END"


def _date_to(v: str, told: str) -> str:
    """What a date is taken as, or null where it stays."""
    by_digit = f"list_filter({_tried(v, 6, _DATE)}, lambda x: x <> {v} AND {_digit('x')} = {told} AND {_READS.format('x')})[1]"
    swapped = f"translate({v}, 'SBG', '586')"
    return f"CASE WHEN {_READS.format(v)} AND ({told} = '<' OR {_digit(v)} = {told}) THEN NULL ELSE coalesce(CASE WHEN {told} <> '<' THEN {by_digit} END, CASE WHEN {swapped} <> {v} AND {_READS.format(swapped)} THEN {swapped} END) END"


def _number_to(v: str, told: str) -> str:
    found = [f"list_filter({_tried(v, 9, swaps)}, lambda x: x <> {v} AND {_digit('x')} = {told})[1]" for swaps in (_NUMBER, _DATE)]
    return f"CASE WHEN {told} <> '<' AND {_digit(v)} <> {told} THEN coalesce({', '.join(found)}) END"


def _four(value: str, raw: str, corrected: str, valid: str) -> str:
    return f"concat_ws('|', {value}, {raw}, ({corrected})::VARCHAR, ({valid})::VARCHAR)"


ZONES_SQL = f"""{PASSPORTS_SQL},
    shown AS (SELECT *, ['TD3', 'TD2', 'TD1'][((doc_id // 6) % 3 + 1)::INT] AS fmt, doc_id % 6 AS k,
                     CASE doc_id % 6 WHEN 1 THEN translate(true_number, '01', 'OI') WHEN 5 THEN substr(true_number, 1, 8) || 'X' ELSE true_number END AS num,
                     CASE doc_id % 6 WHEN 2 THEN translate(dob, '0158', 'OISB') WHEN 5 THEN translate(dob, '6', 'G') ELSE dob END AS birth,
                     CASE doc_id % 6 WHEN 3 THEN translate(exp, '0158', 'OISB') ELSE exp END AS until,
                     CASE doc_id % 6 WHEN 4 THEN 'VNB' WHEN 0 THEN translate(country, 'OI', '01') ELSE country END AS issuing,
                     CASE doc_id % 6 WHEN 4 THEN translate(country, 'OI', '01') WHEN 3 THEN 'D<<' ELSE country END AS nation,
                     CASE WHEN doc_id % 12 = 2 THEN '<' ELSE d1 END AS birth_digit, upper(c_mktsegment) AS segment
              FROM digits JOIN customer ON c_custkey = doc_id),
    start AS (SELECT *, num || n1 || nation || birth || birth_digit || sex || until || e1 AS head,
                     true_number || n1 || dob || d1 || exp || e1 AS covered FROM shown),
    zones AS (SELECT doc_id, fmt, rpad(CASE fmt WHEN 'TD3' THEN 'P<' ELSE 'I<' END || issuing || names, CASE fmt WHEN 'TD3' THEN 44 WHEN 'TD2' THEN 36 ELSE 30 END, '<') AS l1,
                     CASE fmt WHEN 'TD3' THEN head || '<<<<<<<<<<<<<<0' || {_digit("covered || '<<<<<<<<<<<<<<0'")} WHEN 'TD2' THEN head || rpad(doc_id::VARCHAR, 8, '<')
                     ELSE head || '<' || {_digit("covered")} END AS l2, CASE fmt WHEN 'TD1' THEN rpad(segment, 30, '<') ELSE '' END AS l3 FROM start)"""


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fmt, lines: zones of customers, damaged in one way or another; a blank line stands among the lines."""
    d = holders(spark, sf_dir)
    k = F.col("doc_id") % 6
    fmt = F.element_at(F.array(*map(F.lit, ("TD3", "TD2", "TD1"))), (F.floor(F.col("doc_id") / 6) % 3 + 1).cast("int"))
    no_letters = F.translate("country", "OI", "01")
    d = d.withColumns(
        {
            "fmt": fmt,
            "num": F.when(k == 1, F.translate("true_number", "01", "OI")).when(k == 5, F.concat(F.substring("true_number", 1, 8), F.lit("X"))).otherwise(F.col("true_number")),
            "birth": F.when(k == 2, F.translate("dob", "0158", "OISB")).when(k == 5, F.translate("dob", "6", "G")).otherwise(F.col("dob")),
            "until": F.when(k == 3, F.translate("exp", "0158", "OISB")).otherwise(F.col("exp")),
            "issuing": F.when(k == 4, "VNB").when(k == 0, no_letters).otherwise(F.col("country")),
            "nation": F.when(k == 4, no_letters).when(k == 3, "D<<").otherwise(F.col("country")),
            "bd": F.when(F.col("doc_id") % 12 == 2, "<").otherwise(F.col("d1")),
        }
    )
    head = F.concat("num", "n1", "nation", "birth", "bd", "sex", "until", "e1")
    covered = F.concat("true_number", "n1", "dob", "d1", "exp", "e1")
    td3, td2 = F.col("fmt") == "TD3", F.col("fmt") == "TD2"
    names = F.concat(F.when(td3, "P<").otherwise("I<"), F.col("issuing"), F.col("names"))
    l1 = F.when(td3, F.rpad(names, 44, "<")).when(td2, F.rpad(names, 36, "<")).otherwise(F.rpad(names, 30, "<"))
    tail = F.lit("<" * 14 + "0")
    l2 = F.when(td3, F.concat(head, tail, mrz.check_digit(F.concat(covered, tail)))).when(td2, F.concat(head, F.rpad(F.col("doc_id").cast("string"), 8, "<"))).otherwise(F.concat(head, F.lit("<"), mrz.check_digit(covered)))
    lines = F.array(l1, F.lit("  "), l2, F.when(~td3 & ~td2, F.rpad("segment", 30, "<")))
    return d.select("doc_id", "fmt", lines.alias("lines"))


@query(
    "zone_lineage",
    f"""WITH {ZONES_SQL},
    cut AS (SELECT doc_id, fmt, l1, l2, l3, replace(substr(l1, 3, 3), '<', '') AS issuing, substr(l1, 6, CASE fmt WHEN 'TD3' THEN 39 WHEN 'TD2' THEN 31 ELSE 25 END) AS names,
                   substr(l2, 1, 9) AS num, substr(l2, 10, 1) AS nd, replace(substr(l2, 11, 3), '<', '') AS nation, substr(l2, 14, 6) AS birth, substr(l2, 20, 1) AS bd,
                   substr(l2, 22, 6) AS until, substr(l2, 28, 1) AS ed, CASE fmt WHEN 'TD3' THEN substr(l2, 29, 14) WHEN 'TD2' THEN substr(l2, 29, 8) ELSE trim(replace(substr(l2, 29, 2) || l3, '<', ' ')) END AS opt FROM zones),
    fixed AS (SELECT *, {_number_to("num", "nd")} AS num_to, {_date_to("birth", "bd")} AS birth_to, {_date_to("until", "ed")} AS until_to,
                     translate(issuing, '01', 'OI') AS i1, translate(nation, '01', 'OI') AS a1, translate(names, '01', 'OI') AS named FROM cut),
    taken AS (SELECT *, CASE i1 WHEN 'VNB' THEN 'VNM' ELSE i1 END AS i2, CASE a1 WHEN 'VNB' THEN 'VNM' ELSE a1 END AS a2,
                     trim(replace(split_part(named, '<<', 1), '<', ' ')) AS sur, trim(replace(array_to_string(string_split(named, '<<')[2:], '<'), '<', ' ')) AS giv,
                     replace(coalesce(num_to, num), '<', '') AS number, {_iso("coalesce(birth_to, birth)")} AS born, {_iso("coalesce(until_to, until)")} AS ends FROM fixed),
    checked AS (SELECT *, {_digit("num")} = nd OR nd = '<' OR num_to IS NOT NULL AS c1, {_digit("birth")} = bd OR bd = '<' OR birth_to IS NOT NULL AS c2, {_digit("until")} = ed OR ed = '<' OR until_to IS NOT NULL AS c3,
                       CASE fmt WHEN 'TD3' THEN {_digit("opt")} = substr(l2, 43, 1) OR substr(l2, 43, 1) IN ('<', '') WHEN 'TD2' THEN {_digit("opt")} = substr(l2, 36, 1) OR substr(l2, 36, 1) IN ('<', '') ELSE true END AS c4 FROM taken),
    whole AS (SELECT *, CASE fmt WHEN 'TD3' THEN {_digit("(substr(l2, 1, 10) || substr(l2, 14, 7) || substr(l2, 22, 22))")} = substr(l2, 44, 1) WHEN 'TD2' THEN c1
                     ELSE {_digit("(substr(l2, 1, 10) || substr(l2, 14, 7) || substr(l2, 22, 7))")} = substr(l2, 30, 1) OR substr(l2, 30, 1) = '<' END AS c5 FROM checked)
    SELECT doc_id, fmt AS format, {_four("CASE fmt WHEN 'TD3' THEN 'PASSPORT' ELSE 'ID_CARD' END", "substr(l1, 1, 1)", "false", "true")} AS document_type,
        {_four("i2", "i2", "i2 <> issuing", "length(i2) = 3")} AS issuing_country, {_four("sur", "named", "named <> names", "sur <> ''")} AS surname, {_four("giv", "named", "named <> names", "giv <> ''")} AS given_name,
        {_four("trim(sur || ' ' || giv)", "named", "named <> names", "sur <> '' OR giv <> ''")} AS full_name, {_four("number", "replace(num, '<', '')", "num_to IS NOT NULL", "number <> ''")} AS passport_number,
        {_four("a2", "a2", "a2 <> nation", "length(a2) = 3")} AS nationality, {_four("born", "birth", "birth_to IS NOT NULL", "born <> ''")} AS date_of_birth,
        {_four("CASE WHEN substr(l2, 21, 1) IN ('M', 'F') THEN substr(l2, 21, 1) ELSE 'UNKNOWN' END", "substr(l2, 21, 1)", "false", "substr(l2, 21, 1) IN ('M', 'F')")} AS gender,
        {_four("ends", "until", "until_to IS NOT NULL", "ends <> ''")} AS expiry_date, {_four("CASE fmt WHEN 'TD1' THEN opt ELSE trim(replace(opt, '<', '')) END", "opt", "false", "true")} AS optional_data,
        concat_ws(';', CASE WHEN issuing <> i1 THEN 'issuing_country:' || issuing || '>' || i1 || ':ocr_fix' END, CASE WHEN i1 <> i2 THEN 'issuing_country:' || i1 || '>' || i2 || ':ocr_fix' END,
            CASE WHEN names <> named THEN 'name:' || names || '>' || named || ':ocr_fix' END, 'passport_number:' || num || '>' || num_to || ':checksum_fix',
            CASE WHEN nation <> a1 THEN 'nationality:' || nation || '>' || a1 || ':ocr_fix' END, CASE WHEN a1 <> a2 THEN 'nationality:' || a1 || '>' || a2 || ':ocr_fix' END) AS corrections,
        concat_ws('|', c1::VARCHAR, c2::VARCHAR, c3::VARCHAR, c4::VARCHAR, c5::VARCHAR) AS checks, c1 AND c2 AND c3 AND c5 AS overall_valid FROM whole""",
)
def zone_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four parts of all fields, the corrections and the checks."""
    read = lineage.repaired_records(zones(spark, sf_dir).drop("fmt"), "lines")
    four = [F.concat_ws("|", *[F.col(f"record.{n}.{part}").cast("string") for part in ("value", "raw", "corrected", "valid")]).alias(n) for n in lineage.FIELDS]
    told = F.array_join(F.transform("record.corrections", lambda c: F.concat(c["field"], F.lit(":"), c["from"], F.lit(">"), c["to"], F.lit(":"), c["reason"])), ";")
    checks = F.concat_ws("|", *[F.col(f"record.checks.{n}").cast("string") for n in ("passport_number", "date_of_birth", "expiry_date", "optional_data", "composite")])
    return read.select("doc_id", "record.format", *four, told.alias("corrections"), checks.alias("checks"), "record.overall_valid")


@query(
    "normalised_lineage",
    """SELECT c_custkey, upper(trim(c_name)) AS full_name, coalesce(upper(nullif(trim(substr(c_mktsegment, 1, 3)), '')), '') AS country_code, regexp_replace(c_name, '[^0-9A-Za-z]', '', 'g') AS document_number,
        c_name || '|' || substr(c_mktsegment, 1, 3) || '|' || c_name AS raw_original FROM customer""",
)
def normalised_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names, codes and numbers put right, with what they were."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_name").alias("full_name"), F.substring("c_mktsegment", 1, 3).alias("country_code"), F.col("c_name").alias("document_number"))
    rules = {"full_name": F.upper(F.trim("full_name")), "country_code": F.coalesce(F.upper(F.trim("country_code")), F.lit("")), "document_number": F.regexp_replace("document_number", "[^0-9A-Za-z]", "")}
    kept = lineage.normalised(rows, rules)
    return kept.select("c_custkey", *rules, F.concat_ws("|", *[F.col(f"raw_original.{n}") for n in rules]).alias("raw_original"))
