"""Queries over what reviewers are shown and change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import review
from millrace.operators import reviews
from millrace.plans.registry import AS_OF, exact, query, table


def _pick(values: list[str | None], by: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


_AMBIGUOUS = "regexp_matches(upper({0}), '[01258OISBZG69]')"


@query(
    "recommendations",
    f"""WITH g AS (SELECT c_custkey, [ 'Al', 'A1234', 'Nguyen', '', c_name][(c_custkey % 5 + 1)::INT] AS name, ['Nguyen', ''][(c_custkey % 2 + 1)::INT] AS surname,
        ['000000', 'P77', 'O1234567', NULL][(c_custkey % 4 + 1)::INT] AS passport, ['', '3479', 'S34'][(c_custkey % 3 + 1)::INT] AS card,
        (c_custkey % 7)::INT AS b, DATE '2024-01-01' + (c_custkey * 7 % 400)::INT AS expiry, ['VN', 'VNM', NULL][(c_custkey % 3 + 1)::INT] AS nationality FROM customer),
    d AS (SELECT *, expiry - DATE '{AS_OF}' AS days FROM g)
    SELECT c_custkey, concat_ws(';', CASE WHEN name <> '' AND length(name) < 3 THEN 'fullName:high:NAME_TOO_SHORT' END, CASE WHEN name <> '' AND length(regexp_replace(name, '[^0-9]', '', 'g')) / length(name) > 0.5 THEN 'fullName:high:NAME_MOSTLY_DIGITS' END,
        CASE WHEN surname <> '' AND name = surname THEN 'fullName:medium:GIVEN_NAME_MISSING' END, CASE WHEN {_AMBIGUOUS.format("passport")} THEN 'passportNumber:high:AMBIGUOUS_CHARACTERS' END,
        CASE WHEN passport = '000000' THEN 'passportNumber:high:PLACEHOLDER_NUMBER' END, CASE WHEN passport = 'P77' THEN 'passportNumber:medium:NUMBER_TOO_SHORT' END,
        CASE WHEN {_AMBIGUOUS.format("card")} THEN 'idNumber:medium:AMBIGUOUS_CHARACTERS' END,
        CASE b WHEN 1 THEN 'dateOfBirth:high:AGE_TOO_HIGH' WHEN 2 THEN 'dateOfBirth:high:INFANT' WHEN 3 THEN 'dateOfBirth:medium:DAY_FIRST' WHEN 4 THEN 'dateOfBirth:high:UNREADABLE_DATE' END,
        CASE WHEN days BETWEEN 0 AND 89 THEN 'passportExpiryDate:high:EXPIRES_SOON' WHEN days < 0 THEN 'passportExpiryDate:high:EXPIRED' END, CASE WHEN length(nationality) = 2 THEN 'nationality:low:TWO_LETTER_COUNTRY' END) AS advice FROM d""",
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 5 == 4, F.col("c_name")).otherwise(_pick(["Al", "A1234", "Nguyen", "", ""], k))
    # By place: none, too old, an infant, a day that comes first, no month at all, month first, ISO.
    birth = _pick(["", "1900-01-01", "2024-05-01", "31/12/1990", "31/31/1990", "12/31/1990", "1990-12-31"], k)
    expiry = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k * 7 % 400).cast("int")), "yyyy-MM-dd")
    advice = review.recommendations(name, _pick(["Nguyen", ""], k), _pick(["000000", "P77", "O1234567", None], k), _pick(["", "3479", "S34"], k), birth, expiry, _pick(["VN", "VNM", None], k), AS_OF)
    rows = F.transform(advice, lambda a: F.concat_ws(":", a["field"], a["priority"], a["code"]))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(rows, ";").alias("advice"))


@query(
    "error_classes",
    """WITH c(k, code, severity, retryable) AS (VALUES (0, 'TIMEOUT', 'error', true), (1, 'IPC_UNAVAILABLE', 'critical', false), (2, 'VALIDATION_ERROR', 'warning', false), (3, 'NETWORK_ERROR', 'error', true), (4, 'NO_IMAGE', 'error', false), (5, NULL, 'error', false)),
    l(j, level, shown) AS (VALUES (0, 'DEBUG', 0), (1, 'INFO', 0), (2, 'WARN', 1), (3, 'ERROR', 1), (4, 'OTHER', 0))
    SELECT code, severity, retryable, count(*) AS n, sum(shown)::BIGINT AS n_shown FROM events JOIN c ON event_id % 6 = k JOIN l ON event_id % 5 = j GROUP BY ALL""",
)
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by class, and how many of them a log shows that begins at warnings."""
    k = F.col("event_id")
    code = _pick(["TIMEOUT", "IPC_UNAVAILABLE", "VALIDATION_ERROR", "NETWORK_ERROR", "NO_IMAGE", None], k)
    level = _pick(["DEBUG", "INFO", "WARN", "ERROR", "OTHER"], k)
    e = table(spark, sf_dir, "events").select(code.alias("code"), level.alias("level"))
    kind = review.error_class(F.col("code"))
    return e.groupBy("code", kind["severity"].alias("severity"), kind["retryable"].alias("retryable")).agg(F.count("*").alias("n"), F.count_if(review.at_least(F.col("level"), "WARN")).alias("n_shown"))


@query(
    "zone_bands",
    """WITH b AS (SELECT l_orderkey, list({'first': (l_partkey % 100)::INT, 'last': (l_partkey % 100 + l_quantity)::INT, 'density': l_discount * 2} ORDER BY l_linenumber, l_partkey, l_quantity, l_discount) AS bands FROM lineitem GROUP BY ALL),
    f AS (SELECT l_orderkey, list_filter(bands, lambda x: x.first >= 40 AND x.last - x.first + 1 BETWEEN 5 AND 40) AS fit FROM b),
    r AS (SELECT l_orderkey, CASE WHEN len(fit) > 0 THEN list_reduce(fit, lambda a, b: CASE WHEN b.density - a.density > 0.05 OR (abs(b.density - a.density) <= 0.05 AND b.first > a.first) THEN b ELSE a END) END AS best FROM f)
    SELECT l_orderkey, coalesce(best.first, -1) AS first_row, coalesce(best.last, -1) AS last_row, CASE WHEN best IS NULL THEN 'UNKNOWN' WHEN (best.last - best.first + 1) / 100.0 > 0.1 THEN 'TD2' ELSE 'TD3' END AS format FROM r""",
)
def zone_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as text bands of an image of 100 rows; an order has few."""
    first = (F.col("l_partkey") % 100).cast("int")
    band = F.struct(first.alias("first"), (first + F.col("l_quantity")).cast("int").alias("last"), (F.col("l_discount") * 2).alias("density"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_discount", band.alias("band"))))
    best = review.choose_band(F.transform(rows, lambda r: r["band"]), F.lit(100), 0.4, 0.05, 0.4)
    b = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(best.alias("best"))
    height = F.col("best.last") - F.col("best.first") + 1
    fmt = review.zone_format(F.when(F.col("best").isNull(), 0).otherwise(2), height, F.lit(100))
    return b.select("l_orderkey", F.coalesce("best.first", F.lit(-1)).alias("first_row"), F.coalesce("best.last", F.lit(-1)).alias("last_row"), fmt.alias("format"))


@query(
    "staff_reviews",
    """WITH e AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS name, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'O') AS nationality FROM orders GROUP BY ALL)
    SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_name ELSE coalesce(name, c_name) END AS full_name, CASE WHEN c_nationkey = 3 THEN c_mktsegment ELSE coalesce(nationality, c_mktsegment) END AS nationality,
           c_acctbal::VARCHAR AS balance, concat_ws(';', CASE WHEN c_nationkey < 5 THEN 'fullName' END, CASE WHEN c_nationkey % 2 = 0 THEN 'nationality' END) AS low,
           c_nationkey <> 3 AND (name IS NOT NULL OR nationality IS NOT NULL) AS has_edits FROM customer LEFT JOIN e ON c_custkey = o_custkey""",
)
def staff_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under review; orders are edits, those in state P of a field that nobody may edit. Records of nation 3 were confirmed before."""
    n = F.col("c_nationkey")
    fields = F.create_map(F.lit("fullName"), F.col("c_name"), F.lit("nationality"), F.col("c_mktsegment"), F.lit("balance"), F.col("c_acctbal").cast("string"))
    levels = F.create_map(F.lit("nationality"), F.when(n % 2 == 0, "MEDIUM").otherwise("HIGH"), F.lit("fullName"), F.when(n < 5, "LOW").otherwise("HIGH"))
    status = F.col("o_orderstatus")
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("seq"), F.when(status == "F", "fullName").when(status == "O", "nationality").otherwise("balance").alias("field"), F.col("o_orderpriority").alias("value"))
    open_ = reviews.pending(table(spark, sf_dir, "customer"), "c_custkey", fields, levels, n == 3)
    done = reviews.confirm(reviews.edited(open_, changes, "c_custkey"), AS_OF)
    value = {k: F.try_element_at(F.col("result"), F.lit(k)) for k in ("fullName", "nationality", "balance")}
    return done.select("c_custkey", value["fullName"].alias("full_name"), value["nationality"].alias("nationality"), value["balance"].alias("balance"), F.array_join("low", ";").alias("low"), "has_edits")


DEFAULTS = {"capture": {"mode": "auto", "retries": "3"}, "fill": {"delay": "50"}}


@query(
    "settings_merge",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'auto' END AS mode, '3' AS retries, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS extra, '50' AS delay, 2 AS n_sections,
           CASE WHEN c_custkey % 2 = 0 THEN 'capture' ELSE '' END AS changed FROM customer""",
)
def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored settings over the defaults: half have a section of their own, all one that is not known."""
    own = F.create_map(F.lit("mode"), F.col("c_mktsegment"), F.lit("extra"), F.col("c_name"))
    other = F.create_map(F.lit("x"), F.lit("y"))
    stored = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("capture"), own, F.lit("odd"), other)).otherwise(F.create_map(F.lit("odd"), other))
    t = table(spark, sf_dir, "customer").select("c_custkey", review.merged_sections(stored, DEFAULTS).alias("s"), review.merged_sections(F.lit(None).cast("map<string,map<string,string>>"), DEFAULTS).alias("d"))

    def value(section: str, key: str) -> F.Column:
        return F.try_element_at(F.try_element_at(F.col("s"), F.lit(section)), F.lit(key)).alias(key)

    return t.select("c_custkey", value("capture", "mode"), value("capture", "retries"), value("capture", "extra"), value("fill", "delay"), F.size("s").alias("n_sections"), F.array_join(review.changed_sections(F.col("d"), F.col("s"), ("capture", "fill")), ";").alias("changed"))


@query(
    "fields_to_copy",
    """SELECT c_custkey, concat_ws(';', CASE WHEN c_nationkey >= 10 THEN 'name' END, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'segment' END) AS high, CASE WHEN c_nationkey BETWEEN 5 AND 9 THEN 'name' ELSE '' END AS medium,
           concat('segment,name|', CASE WHEN c_nationkey >= 10 THEN '1.0' WHEN c_nationkey >= 5 THEN '0.8' ELSE '0.4' END) AS shown FROM customer""",
)
def fields_to_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with their accuracy; the segment has none, a building's is empty."""
    n, segment = F.col("c_nationkey"), F.col("c_mktsegment")
    values = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.when(segment != "BUILDING", segment), F.lit("unlisted"), F.lit("x"))
    levels = F.create_map(F.lit("name"), F.when(n >= 10, "HIGH").when(n >= 5, "MEDIUM").otherwise("LOW"))
    scores = F.create_map(F.lit("name"), F.when(n >= 10, 1.0).when(n >= 5, 0.8).otherwise(0.4))
    given = review.fields_in_order(values, levels, scores, ("segment", "absent", "name"))
    t = table(spark, sf_dir, "customer").select("c_custkey", given.alias("f"))
    high, medium = review.copyable(F.col("f")), review.copyable(F.col("f"), "MEDIUM")
    shown = F.concat(F.array_join(F.col("f.key"), ","), F.lit("|"), F.element_at(F.col("f.score"), -1).cast("string"))
    return t.select("c_custkey", F.array_join(F.array_sort(high), ";").alias("high"), F.array_join(medium, ";").alias("medium"), shown.alias("shown"))


@query(
    "zone_findings",
    """WITH r AS (SELECT c_custkey, c_nationkey AS n, upper(c_mktsegment) AS s FROM customer)
    SELECT c_custkey, CASE WHEN n < 8 THEN 'VNM' WHEN n < 16 THEN 'FRA' END AS country,
           array_to_string(list_filter(range(0, length(s)), lambda i: position(substr(s, i + 1, 1) IN 'O0I1') > 0), ',') AS in_number, array_to_string(list_filter(range(0, length(s)), lambda i: position(substr(s, i + 1, 1) IN 'O0I1LZSBG') > 0), ',') AS in_date,
           round(0.5 * (n / 25.0) + 0.5 * ((CASE WHEN n < 5 THEN 1 ELSE 0 END + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) / 2.0), 6)::DOUBLE AS score,
           CASE WHEN n % 3 = 0 THEN 'A;B;C' ELSE 'B;C' END AS warnings,
           CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN '1 error in 1 field' ELSE '3 errors in 2 fields' END AS summary FROM r""",
)
def zone_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries, places that may be misread, scores, merged warnings and summaries of errors."""
    n, s = F.col("c_nationkey"), F.upper("c_mktsegment")
    lines = F.array(F.lit("P<"), F.when(n < 8, "P<VNMNGUYEN").when(n < 16, "P<D<<X").otherwise("P<1234"), F.when(n < 16, "IDFRAX").otherwise(""))
    checks = F.create_map(F.lit("number"), n < 5, F.lit("birth"), n % 2 == 0)
    warnings = review.merged_lists(F.when(n % 3 == 0, F.array(F.lit("A"), F.lit("B"))), F.array(F.lit("B"), F.lit("C")), F.array(F.lit("C")))
    one, two = F.array(F.lit("x")), F.array(F.lit("x"), F.lit("y"))
    errors = F.when(n % 3 == 1, F.create_map(F.lit("a"), one)).when(n % 3 == 2, F.create_map(F.lit("a"), one, F.lit("b"), two))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        review.country_of_lines(lines).alias("country"),
        F.array_join(review.ambiguous_positions(s, "number").cast("array<string>"), ",").alias("in_number"),
        F.array_join(review.ambiguous_positions(s, "date").cast("array<string>"), ",").alias("in_date"),
        exact(review.total_score(n / 25, checks)).alias("score"),
        F.array_join(warnings, ";").alias("warnings"),
        review.error_summary(errors).alias("summary"),
    )
