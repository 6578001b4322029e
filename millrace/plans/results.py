"""Queries over recognisers' results as records, and the cleaning of single texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import mrz, results, rules
from millrace.functions import text as tx
from millrace.functions.dates import expiry_state
from millrace.plans.fields import _DOCUMENTS, _ISO, _documents
from millrace.plans.registry import AS_OF, exact, query, table


@query(
    "guest_results",
    f"""WITH {_DOCUMENTS}, d AS (SELECT *, {_ISO.replace("(v,", "(expiry,")} AS e, CASE WHEN priority LIKE '1%' THEN 'PASSPORT' WHEN priority LIKE '2%' THEN 'ID_CARD' ELSE 'UNKNOWN' END AS kind FROM docs),
    w AS (SELECT *, list_filter([CASE WHEN birth = '' THEN 'MISSING_REQUIRED_FIELD' END, CASE WHEN e < DATE '{AS_OF}' THEN 'DOCUMENT_EXPIRED' END], lambda x: x IS NOT NULL) AS w, CASE WHEN overall >= 0.9 THEN 'HIGH' WHEN overall >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS lev FROM d)
    SELECT id, name AS full_name, CASE WHEN gender <> 'O' THEN surname END AS surname, nation AS nationality, kind, CASE WHEN kind <> 'ID_CARD' THEN expiry END AS passport_expiry, CASE WHEN kind = 'ID_CARD' THEN expiry END AS id_expiry,
        CASE WHEN list_contains(w, 'DOCUMENT_EXPIRED') THEN 'NEED_REVIEW' WHEN len(w) > 0 THEN 'MISSING_DATA' WHEN lev = 'LOW' THEN 'NEED_REVIEW' ELSE 'READY' END AS status, CASE WHEN len(w) > 0 THEN array_to_string(w, '; ') END AS warnings,
        CASE WHEN gender <> 'O' THEN 5 ELSE 4 END::BIGINT AS n_confidences, round(coalesce(own, 0), 6)::DOUBLE AS name_confidence FROM w""",
)
def guest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a recogniser's nested results, then as guests' rows; surnames are missing for some."""
    t, record = _documents(spark, sf_dir)

    def field(name: str):
        return F.struct(record[name].alias("value"), F.coalesce("own", F.lit(0.0)).alias("confidence"))

    nested = F.create_map(
        F.lit("fullName"), field("fullName"), F.lit("lastName"), F.when(record["gender"] != "O", field("surname")), F.lit("nationality"), field("nationality"), F.lit("dateOfBirth"), field("dateOfBirth"), F.lit("expiryDate"), field("expiryDate")
    )
    p = F.substring("priority", 1, 1)
    warnings = rules.codes((F.col("birth") == "", "MISSING_REQUIRED_FIELD"), (expiry_state(F.col("expiry"), AS_OF) == "EXPIRED", "DOCUMENT_EXPIRED"))
    g = results.guest_record(nested, F.when(p == "1", "PASSPORT").when(p == "2", "ID_CARD"), record["gender"], F.col("overall"), F.when(F.col("overall").isNull(), "LOW").otherwise(rules.level(F.col("overall"))), warnings)
    r = t.select("id", g.alias("g"))
    sure = F.col("g.fieldConfidence")
    return r.select(
        "id", F.col("g.fullName").alias("full_name"), "g.surname", "g.nationality", F.col("g.documentType").alias("kind"), F.col("g.passportExpiryDate").alias("passport_expiry"), F.col("g.idExpiryDate").alias("id_expiry"), "g.status",
        F.col("g.ocrWarning").alias("warnings"), F.size(sure).cast("long").alias("n_confidences"), exact(F.try_element_at(sure, F.lit("fullName"))).alias("name_confidence"),
    )


@query(
    "zone_results",
    """WITH l AS (SELECT c_custkey, rpad('P<UTO' || replace(upper(c_name), '#', '<'), 44, '<') AS l1, lpad(c_custkey::VARCHAR, 9, '1') AS num FROM customer),
    d AS (SELECT *, list_sum([substr(num, i, 1)::INT * [7, 3, 1][(i - 1) % 3 + 1] FOR i IN range(1, 10)]) % 10 AS digit FROM l)
    SELECT c_custkey, num AS passport_number, num AS document_number, l1 || chr(10) || num || '7UTO7408122F1204159' || repeat('<', 14) || '<0' AS raw, digit = 7 OR c_custkey % 3 = 0 AS number_valid, TRUE AS birth_valid,
        CASE WHEN c_custkey % 3 = 0 THEN (digit = 7)::VARCHAR ELSE '' END AS all_checked FROM d""",
)
def zone_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passport lines with the digit 7 for each number; for every third, the parser's own map says that the number is valid."""
    k = F.col("c_custkey")
    l1 = F.rpad(F.concat(F.lit("P<UTO"), F.replace(F.upper("c_name"), F.lit("#"), F.lit("<"))), 44, "<")
    l2 = F.concat(F.lpad(k.cast("string"), 9, "1"), F.lit("7UTO7408122F1204159" + "<" * 15 + "0"))
    t = table(spark, sf_dir, "customer").select(k, l1.alias("l1"), l2.alias("l2"))
    fmt = F.lit("TD3")
    v = {n: mrz.digit_ok(mrz.at(F.col("l2"), at, size), mrz.at(F.col("l2"), place, 1)) for n, (at, size, place) in mrz.FIELDS.items()}
    checks = {n: v.get(n, F.lit(True)) for n in results.CHECKS}
    merged = results.merged_checks(checks, F.when(k % 3 == 0, F.create_map(F.lit("passport_number_valid"), F.lit(True))))
    r = t.select(k, results.parsed_record(mrz.parse(F.col("l1"), F.col("l2"), F.lit(""), fmt), merged, F.array("l1", "l2")).alias("r"), v["passport_number"].alias("own"))
    own = F.create_map(F.lit("passport_number_valid"), F.col("own"), F.lit("date_of_birth_valid"), F.element_at("r.checkDigits", "date_of_birth_valid"), F.lit("other"), F.lit(False))
    return r.select(
        k, F.col("r.passportNumber").alias("passport_number"), F.col("r.documentNumber").alias("document_number"), F.col("r.mrzRaw").alias("raw"), F.element_at("r.checkDigits", "passport_number_valid").alias("number_valid"),
        F.element_at("r.checkDigits", "date_of_birth_valid").alias("birth_valid"), F.when(k % 3 == 0, rules.all_present_true(own, ("passport_number_valid", "date_of_birth_valid")).cast("string")).otherwise("").alias("all_checked"),
    )


@query(
    "cleaned_texts",
    """WITH w AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, md5(array_to_string([x FOR x IN regexp_split_to_array(trim(t, ' '), '\\s+') IF regexp_full_match(x, '[A-Za-z]{1,15}') AND (length(x) <= 4 OR len(list_distinct(string_split(x, ''))) > 2)], ' ')) AS tokens,
        md5(regexp_replace(t, '[^0-9/.-]', '', 'g')) AS as_date, md5(regexp_replace(upper(replace(t, 'ß', 'SS')), '[^A-Z0-9]', '', 'g')) AS as_number, md5(trim(regexp_replace(regexp_replace(t, '[^A-Za-zÀ-ÿ'' -]', '', 'g'), ' +', ' ', 'g'), ' ')) AS as_name,
        md5(translate(t, 'OIZSB', '01258')) AS corrected_date, md5(translate(t, 'OI', '01')) AS corrected_number, md5(translate(t, '01', 'OI')) AS corrected_name FROM w""",
)
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as if they were names, dates and numbers: noisy tokens, each kind's own characters, blanket corrections."""
    v = F.coalesce("text", F.lit(""))
    made = {
        "tokens": tx.clean_name_tokens(v), "as_date": tx.clean_visual_text(v, "dateOfBirth"), "as_number": tx.clean_visual_text(v, "passportNumber"), "as_name": tx.clean_visual_text(v, "fullName"),
        "corrected_date": mrz.blanket_corrections(v, "date"), "corrected_number": mrz.blanket_corrections(v, "number"), "corrected_name": mrz.blanket_corrections(v, "name"),
    }
    return table(spark, sf_dir, "documents").select("doc_id", *[F.md5(c).alias(n) for n, c in made.items()])
