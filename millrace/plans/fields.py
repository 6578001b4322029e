"""Queries over fields in long form: their validation in both dialects, documents that are ready, quick fixes, advice across fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import fields
from millrace.functions.desk import PATTERNS
from millrace.operators import reviews
from millrace.plans.registry import AS_OF, exact, query
from millrace.plans.safety import _RECORDS, _records

#: Orders as documents: names with marks at their ends, numbers of three shapes from their customers' keys, countries as written and cut.
_DOCUMENTS = (
    _RECORDS.replace("o_orderstatus AS gender", "CASE WHEN o_orderpriority LIKE '2%' THEN 'X' WHEN o_orderpriority LIKE '3%' THEN 'UNKNOWN' WHEN o_orderpriority LIKE '4%' THEN 'Female' ELSE o_orderstatus END AS gender, 'Clerk#' || lpad(o_custkey::VARCHAR, 9, '0') AS clerk, o_orderpriority AS priority, n_name")
    + """, docs AS (SELECT *, CASE WHEN priority LIKE '1%' THEN ' ' || name || ' #' WHEN priority LIKE '2%' THEN '--' || segment WHEN priority LIKE '4%' THEN repeat(segment, 12) ELSE '*7' || name END AS surname,
        CASE WHEN priority LIKE '1%' THEN ' p<' || substr(clerk, 9) WHEN priority LIKE '2%' THEN substr(clerk, 13) WHEN priority LIKE '3%' THEN clerk ELSE '00' || id END AS passport,
        CASE WHEN gender = 'F' THEN ' ' || lower(substr(n_name, 1, 3)) ELSE substr(n_name, 1, 3) END AS issuer FROM r)"""
)
_LONG = """f AS (SELECT id, own, overall, 'fullName' AS field, name AS v FROM docs UNION ALL SELECT id, own, overall, 'surname', surname FROM docs UNION ALL SELECT id, own, overall, 'passportNumber', passport FROM docs
        UNION ALL SELECT id, own, overall, 'nationality', nation FROM docs UNION ALL SELECT id, own, overall, 'issuingCountry', issuer FROM docs UNION ALL SELECT id, own, overall, 'dateOfBirth', birth FROM docs
        UNION ALL SELECT id, own, overall, 'expiryDate', expiry FROM docs UNION ALL SELECT id, own, overall, 'gender', gender FROM docs{more})"""


def _sql_codes(*pairs: tuple[str, str]) -> str:
    return "[x FOR x IN [" + ", ".join(f"CASE WHEN {test} THEN '{code}' END" for test, code in pairs) + "] IF x IS NOT NULL]"


_COUNTRIES = "('" + "','".join(fields.COUNTRY_CODES) + "')"
_OLDER_COUNTRIES = "('" + "','".join(c for c in fields.COUNTRY_CODES if c not in fields.LATER_COUNTRIES) + "')"
_ISO = "CASE WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_strptime(v, '%Y-%m-%d')::DATE END"
_DATES = (
    ("kind IN ('birth', 'expiry') AND d IS NULL", "INVALID_DATE"),
    (f"kind = 'birth' AND d > DATE '{AS_OF}'", "FUTURE_DATE"),
    ("kind = 'birth' AND d < DATE '1900-01-01'", "UNUSUALLY_OLD"),
    ("kind = 'birth' AND (age < 0 OR age > 120)", "UNUSUAL_AGE"),
    (f"kind = 'expiry' AND d < DATE '{AS_OF}'", "EXPIRED"),
    (f"kind = 'expiry' AND d >= DATE '{AS_OF}' AND d < DATE '{AS_OF}' + INTERVAL 3 MONTH", "EXPIRING_SOON"),
    ("kind = 'expiry' AND d > DATE '2100-01-01'", "UNUSUAL_EXPIRY"),
)
_KIND = "CASE WHEN field IN ('fullName', 'surname') THEN 'name' WHEN field = 'passportNumber' THEN 'passport' WHEN field IN ('nationality', 'issuingCountry') THEN 'country' WHEN field = 'dateOfBirth' THEN 'birth' WHEN field = 'expiryDate' THEN 'expiry' WHEN field = 'gender' THEN 'gender'{more} ELSE 'other' END"
_SERVICE = f"""k AS (SELECT *, {_KIND.format(more=" WHEN field = 'documentType' THEN 'document'")} AS kind, {_ISO} AS d, coalesce(own, 0.85) AS sure, overall >= 0.5 AS passed, overall IS NULL AS zone FROM f WHERE v <> ''),
    a AS (SELECT *, date_sub('year', d, DATE '{AS_OF}') - (d > DATE '{AS_OF}' AND date_sub('year', d, DATE '{AS_OF}') = 0)::INT AS age, replace(upper(trim(v)), '<', '') AS bare,
        trim(regexp_replace(trim(regexp_replace(trim(v), '^([A-Za-z\\s''.-]+?)[^A-Za-z\\s''.-]+$', '\\1')), '^[^A-Za-z\\s''.-]+(.+)$', '\\1')) AS cleaned FROM k),
    b AS (SELECT *, kind = 'country' AND length(bare) = 3 AND bare NOT IN {_COUNTRIES} AS strange,
        CASE WHEN NOT regexp_full_match(bare, '[A-Z0-9]{{3}}') THEN NULL WHEN bare[1:2] = 'VN' THEN 'VNM' WHEN bare[1:2] = 'UT' THEN 'UTO' WHEN bare[1] = 'D' THEN 'DEU' WHEN bare[1:2] = 'FR' THEN 'FRA' WHEN bare[1:2] = 'GB' THEN 'GBR' WHEN bare[1:2] = 'US' THEN 'USA'
        WHEN bare[1:2] = 'CN' THEN 'CHN' WHEN bare[1] = 'J' THEN 'JPN' WHEN bare[1] = 'K' THEN 'KOR' WHEN bare[1] = 'I' THEN 'IND' WHEN bare[1:2] = 'TH' THEN 'THA' WHEN bare[1] = 'S' THEN 'SGP' WHEN bare[1] = 'M' THEN 'MYS' END AS better FROM a),
    c AS (SELECT *, CASE WHEN kind = 'name' THEN cleaned WHEN kind = 'passport' AND bare <> '' THEN bare WHEN kind = 'country' AND length(bare) = 3 THEN CASE WHEN strange THEN coalesce(better, v) ELSE bare END ELSE v END AS val FROM b),
    e AS (SELECT *, CASE WHEN strange AND better IS NOT NULL THEN bare WHEN kind = 'country' AND val <> v THEN v END AS repaired, {_sql_codes(
        ("(kind = 'name' AND NOT regexp_full_match(cleaned, '[A-Za-z\\s''.-]+')) OR (kind = 'passport' AND NOT regexp_full_match(bare, '[A-Z0-9]{5,20}'))", "INVALID_FORMAT"),
        ("kind = 'name' AND cleaned <> v AND cleaned <> ''", "TRAILING_OCR_NOISE"), ("kind = 'passport' AND bare <> v", "PASSPORT_NORMALIZED"), ("kind = 'name' AND length(v) > 100", "TOO_LONG"),
        ("kind = 'passport' AND regexp_matches(bare, '[OIL]')", "AMBIGUOUS_CHARS"), ("kind = 'passport' AND length(bare) BETWEEN 1 AND 4", "TOO_SHORT"), ("kind = 'country' AND length(bare) <> 3", "INVALID_LENGTH"),
        ("strange AND better IS NOT NULL", "COUNTRY_CODE_REPAIRED"), ("strange AND better IS NULL", "UNRECOGNIZED_COUNTRY"), *_DATES,
        ("kind = 'gender' AND v NOT IN ('M', 'F', 'X', 'UNKNOWN')", "INVALID_GENDER"), ("kind = 'gender' AND v = 'UNKNOWN'", "GENDER_UNKNOWN"), ("kind = 'document' AND v NOT IN ('PASSPORT', 'ID_CARD', 'UNKNOWN')", "UNSUPPORTED_TYPE"))} AS i FROM c),
    g AS (SELECT *, list_has_any(i, ['{"', '".join(fields.ERRORS)}']) AS bad, CASE WHEN kind = 'other' THEN sure ELSE least(1, CASE WHEN repaired IS NOT NULL THEN greatest(0, sure - 0.1) ELSE sure END + CASE WHEN passed THEN 0.15 WHEN zone THEN 0.075 ELSE 0 END) END AS adj FROM e),
    h AS (SELECT id, field, val AS value, adj, kind = 'other' OR (NOT bad AND round(adj, 9) >= 0.4) AS valid, kind <> 'other' AND (bad OR round(adj, 9) < 0.7) AS needs_review, repaired IS NOT NULL AS corrected, repaired, i FROM g)"""
_SERVICE_DOCUMENTS = f"WITH {_DOCUMENTS}, {_LONG.format(more=chr(10) + 8 * ' ' + '''UNION ALL SELECT id, own, overall, 'documentType', CASE WHEN priority LIKE '1%' THEN 'PASSPORT' ELSE priority END FROM docs UNION ALL SELECT id, own, overall, 'idNumber', clerk FROM docs''')}, {_SERVICE}"


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    t = _records(spark, sf_dir)
    p = F.substring("priority", 1, 1)
    gender = F.when(p == "2", "X").when(p == "3", "UNKNOWN").when(p == "4", "Female").otherwise(F.col("gender"))
    beginning = F.substring("n_name", 1, 3)
    record = {
        "fullName": F.col("name"),
        "surname": F.when(p == "1", F.concat(F.lit(" "), "name", F.lit(" #"))).when(p == "2", F.concat(F.lit("--"), "segment")).when(p == "4", F.repeat("segment", 12)).otherwise(F.concat(F.lit("*7"), "name")),
        "passportNumber": F.when(p == "1", F.concat(F.lit(" p<"), F.expr("substring(clerk, 9)"))).when(p == "2", F.expr("substring(clerk, 13)")).when(p == "3", F.col("clerk")).otherwise(F.concat(F.lit("00"), F.col("id").cast("string"))),
        "nationality": F.col("nation"), "dateOfBirth": F.col("birth"), "expiryDate": F.col("expiry"), "gender": gender,
        "issuingCountry": F.when(gender == "F", F.concat(F.lit(" "), F.lower(beginning))).otherwise(beginning),
        "documentType": F.when(p == "1", "PASSPORT").otherwise(F.col("priority")), "idNumber": F.col("clerk"),
    }
    return t, record


def _validated(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    t, record = _documents(spark, sf_dir)
    return reviews.validated_fields(t, ["id"], record, AS_OF, F.coalesce("own", F.lit(0.85)), F.col("overall") >= 0.5, F.col("overall").isNull(), dialect)


@query("validated_fields", _SERVICE_DOCUMENTS + " SELECT id, field, value, round(adj, 6)::DOUBLE AS adjusted, valid, needs_review, corrected, repaired, array_to_string(i, ';') AS issues FROM h")
def validated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filled field of every order read as a document; digits pass where it is surely read, the zone alone where nothing is known."""
    v = _validated(spark, sf_dir, "service")
    return v.select("id", "field", "value", exact(F.col("adjusted")).alias("adjusted"), "valid", "needs_review", "corrected", F.col("repaired_from").alias("repaired"), F.array_join("issues", ";").alias("issues"))


@query(
    "validated_fields_older",
    f"""WITH {_DOCUMENTS}, {_LONG.format(more="")}, k AS (SELECT *, {_KIND.format(more="")} AS kind, {_ISO} AS d, least(1, coalesce(own, 0.85) + CASE WHEN overall IS NULL THEN 0.15 ELSE 0 END) AS sure FROM f WHERE v <> ''),
    a AS (SELECT *, {AS_OF[:4]} - year(d) AS age FROM k),
    e AS (SELECT *, {_sql_codes(
        ("(kind = 'name' AND NOT regexp_full_match(v, '[A-Za-z\\s''.-]+')) OR (kind = 'passport' AND NOT regexp_full_match(v, '[A-Z0-9<]{5,20}'))", "INVALID_FORMAT"),
        ("kind = 'name' AND length(v) > 100", "TOO_LONG"), ("kind = 'passport' AND regexp_matches(v, '[OIL]')", "AMBIGUOUS_CHARS"), ("kind = 'country' AND length(v) <> 3", "INVALID_LENGTH"),
        (f"kind = 'country' AND length(v) = 3 AND upper(v) NOT IN {_OLDER_COUNTRIES}", "UNRECOGNIZED_COUNTRY"), *_DATES,
        ("kind = 'gender' AND v NOT IN ('M', 'F', 'UNKNOWN')", "INVALID_GENDER"), ("kind = 'gender' AND v = 'UNKNOWN'", "GENDER_UNKNOWN"))} AS i FROM a),
    g AS (SELECT *, list_has_any(i, ['{"', '".join(fields.ERRORS)}']) AS bad FROM e)
    SELECT id, CASE WHEN kind = 'name' THEN 'fullName' ELSE field END AS field, v AS value, round(sure, 6)::DOUBLE AS adjusted, NOT bad AND round(sure, 9) >= 0.4 AS valid, bad OR round(sure, 9) < 0.7 AS needs_review, array_to_string(i, ';') AS issues FROM g""",
)
def validated_fields_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents by the older rules: values as they are, no repairs, the zone's boost first."""
    return _validated(spark, sf_dir, "util").select("id", "field", "value", exact(F.col("adjusted")).alias("adjusted"), "valid", "needs_review", F.array_join("issues", ";").alias("issues"))


@query(
    "document_readiness",
    _SERVICE_DOCUMENTS
    + """ SELECT id, count(*) AS n_fields, round(avg(adj), 6)::DOUBLE AS overall, coalesce(string_agg(field, ';' ORDER BY field) FILTER (needs_review), '') AS to_review,
    count(*) FILTER (field IN ('fullName', 'passportNumber', 'dateOfBirth', 'expiryDate', 'nationality', 'gender') AND valid AND NOT needs_review) = 6 AS ready FROM h GROUP BY id""",
)
def document_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reviews.document_readiness(_validated(spark, sf_dir, "service"), "id", names=fields.DOCUMENT_FIELDS["service"])
    return rows.select("id", "n_fields", exact(F.col("overall")).alias("overall"), F.array_join("to_review", ";").alias("to_review"), "ready")


#: What passport numbers of a country look like, in SQL: the country's pattern, or any five to twenty letters and digits.
_FITS = (
    "CASE iso "
    + " ".join(f"WHEN '{c}' THEN regexp_full_match(upper({{v}}), '{'|'.join(p)}')" for c, p in PATTERNS.items())
    + " ELSE regexp_full_match({v}, '[A-Za-z0-9]{{5,20}}') END"
).replace("{2}", "{{2}}").replace("{3}", "{{3}}").replace("{5}", "{{5}}").replace("{6}", "{{6}}").replace("{7}", "{{7}}").replace("{8}", "{{8}}").replace("{9}", "{{9}}").replace("{10}", "{{10}}")
_ISO3 = "coalesce(map_from_entries([" + ", ".join(f"('{a}', '{b}')" for a, b in fields.ISO2_TO_ISO3.items()) + "])[{v}], {v})"
_LOOSE = "CASE WHEN regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_strptime({v}, '%Y-%m-%d')::DATE WHEN regexp_full_match({v}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN try_strptime({v}, '%m/%d/%Y')::DATE END"
#: Numbers that may fit a country's passports, dates without marks, sexes in words.
_FIXABLE = f"""{_DOCUMENTS}, x AS (SELECT id, name, nation, {_ISO3.format(v="upper(nation)")} AS iso, n_name, surname, expiry, CASE WHEN priority LIKE '1%' THEN '00000000' WHEN priority LIKE '4%' THEN substr(segment, 1, 2) || lpad(id::VARCHAR, 6, '0') WHEN priority LIKE '5%' THEN lpad(id::VARCHAR, 9, '0') ELSE passport END AS passport,
        CASE WHEN priority LIKE '5%' THEN birth WHEN priority LIKE '4%' THEN replace(birth, '-', '') WHEN priority LIKE '3%' THEN '18' || substr(birth, 3) ELSE birth END AS birth, CASE WHEN priority LIKE '5%' THEN 'male' ELSE gender END AS gender, clerk FROM docs)"""


def _fixable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    t, record = _documents(spark, sf_dir)
    p, key = F.substring("priority", 1, 1), F.col("id").cast("string")
    number = F.when(p == "1", "00000000").when(p == "4", F.concat(F.substring("segment", 1, 2), F.lpad(key, 6, "0"))).when(p == "5", F.lpad(key, 9, "0")).otherwise(record["passportNumber"])
    birth = F.when(p == "4", F.replace("birth", F.lit("-"), F.lit(""))).when((p == "3") & (F.col("birth") != ""), F.concat(F.lit("18"), F.expr("substring(birth, 3)"))).when((p == "3"), "18").otherwise(F.col("birth"))
    return t, record | {"passportNumber": number, "dateOfBirth": birth, "gender": F.when(p == "5", "male").otherwise(record["gender"])}


@query(
    "field_fixes",
    f"""WITH {_FIXABLE}, f AS (SELECT id, iso, nation, 'fullName' AS field, name AS v FROM x UNION ALL SELECT id, iso, nation, 'passportNumber', passport FROM x UNION ALL SELECT id, iso, nation, 'idNumber', clerk FROM x
        UNION ALL SELECT id, iso, nation, 'dateOfBirth', birth FROM x UNION ALL SELECT id, iso, nation, 'gender', gender FROM x UNION ALL SELECT id, iso, nation, 'nationality', nation FROM x),
    d AS (SELECT *, {_LOOSE.format(v="v")} AS d, field IN ('passportNumber', 'idNumber') AS number FROM f WHERE v <> ''), a AS (SELECT *, {AS_OF[:4]} - year(d) AS age FROM d),
    s(c, alike) AS (VALUES ('0', 'O,Q,D'), ('O', '0'), ('1', 'I,L,l'), ('I', '1,l'), ('5', 'S'), ('S', '5'), ('8', 'B'), ('B', '8'), ('2', 'Z'), ('Z', '2'), ('6', 'G'), ('G', '6'), ('9', 'g,q')),
    fixes AS (SELECT id, field, 0 AS place, 0 AS nth, 'review' AS action, 'PLACEHOLDER_NUMBER' AS code, NULL AS new_value FROM a WHERE number AND regexp_full_match(v, '0+')
        UNION ALL SELECT id, field, 1, 0, 'review', 'COUNTRY_FORMAT', NULL FROM a WHERE field = 'passportNumber' AND NOT {_FITS.format(v="v")}
        UNION ALL SELECT id, field, 1 + p.p, n.n, 'replace', 'AMBIGUOUS_CHARACTER', substr(v, 1, p.p - 1) || string_split(alike, ',')[n.n] || substr(v, p.p + 1) FROM a, LATERAL (SELECT unnest(range(1, length(v) + 1)) AS p) p JOIN s ON c = upper(substr(v, p.p, 1)), LATERAL (SELECT unnest(range(1, len(string_split(alike, ',')) + 1)) AS n) n
            WHERE number AND string_split(alike, ',')[n.n] <> substr(v, p.p, 1)
        UNION ALL SELECT id, field, 0, 0, 'review', CASE length(v) WHEN 1 THEN 'NAME_TOO_SHORT' ELSE 'NAME_MAY_BE_CUT' END, NULL FROM a WHERE field = 'fullName' AND length(v) < 3
        UNION ALL SELECT id, field, 1, 0, 'replace', 'DIGITS_IN_NAME', trim(regexp_replace(v, '[0-9]', '', 'g')) FROM a WHERE field = 'fullName' AND regexp_matches(v, '[0-9]')
        UNION ALL SELECT id, field, 0, 0, 'review', 'AGE_OUT_OF_RANGE', NULL FROM a WHERE field = 'dateOfBirth' AND (age < 1 OR age > 120)
        UNION ALL SELECT id, field, 0, 0, 'replace', 'COMPACT_DATE', v[7:8] || '/' || v[5:6] || '/' || v[1:4] FROM a WHERE field = 'dateOfBirth' AND regexp_full_match(v, '[0-9]{{8}}')
        UNION ALL SELECT id, field, 0, 0, 'replace', 'DAY_FIRST', v[7:10] || '-' || v[4:5] || '-' || v[1:2] FROM a WHERE field = 'dateOfBirth' AND d IS NULL AND regexp_full_match(v, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}')
        UNION ALL SELECT id, field, 0, 0, 'replace', 'SEX_IN_WORDS', upper(v[1]) FROM a WHERE field = 'gender' AND upper(v) IN ('MALE', 'FEMALE')
        UNION ALL SELECT id, field, 0, 0, 'replace', 'TWO_LETTER_COUNTRY', iso FROM a WHERE field = 'nationality' AND length(v) = 2 AND length(iso) = 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id, field ORDER BY place, nth) AS rank FROM fixes) SELECT id, field, rank, action, code, new_value FROM ranked WHERE rank <= 5""",
)
def field_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five fixes of six fields of every order read as a document."""
    t, record = _fixable(spark, sf_dir)
    shown = {k: record[k] for k in ("fullName", "passportNumber", "idNumber", "dateOfBirth", "gender", "nationality")}
    return reviews.field_fixes(t, ["id"], shown, AS_OF).withColumn("rank", F.col("rank").cast("long"))


@query(
    "advice_across_fields",
    f"""WITH {_FIXABLE}, d AS (SELECT *, {_LOOSE.format(v="birth")} AS b, {_LOOSE.format(v="expiry")} AS e, {_ISO3.format(v="nation")} AS nat3, {_ISO3.format(v="substr(n_name, 1, 2)")} AS issuer3 FROM x)
    SELECT id, concat_ws(';', CASE WHEN NOT {_FITS.format(v="passport")} THEN 'passportNumber:COUNTRY_FORMAT' END, CASE WHEN nat3 <> issuer3 THEN 'nationality:COUNTRY_MISMATCH' END,
        CASE WHEN NOT contains(lower(name), lower(surname)) AND NOT contains(lower(name), lower(n_name)) THEN 'cross-field:NAME_MISMATCH' END, CASE WHEN e <= b THEN 'dateOfBirth:EXPIRY_BEFORE_BIRTH' END,
        CASE WHEN year(e) - year(b) > 100 THEN 'passportNumber:AGE_AT_EXPIRY' END, CASE WHEN gender NOT IN ('UNKNOWN', 'M') THEN 'gender:GENDER_MISMATCH' END,
        CASE WHEN datediff('day', b, e) / 365.25 > 100 OR datediff('day', b, e) / 365.25 < 15 THEN 'dateOfBirth:IMPLAUSIBLE_VALIDITY' END) AS advice FROM d""",
)
def advice_across_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fields of every order give together; the issuer's code is the first two letters of the country, all names are taken for men's."""
    t, record = _fixable(spark, sf_dir)
    whole = record | {"givenName": F.col("n_name"), "issuingCountry": F.substring("n_name", 1, 2), "passportExpiryDate": record["expiryDate"], "likelyGender": F.lit("M")}
    return t.select("id", F.array_join(F.transform(fields.further_advice(whole, AS_OF), lambda a: F.concat_ws(":", a["field"], a["code"])), ";").alias("advice"))
