"""Queries over what recognisers give: staged passes, near lines, confidence over fields, boxes, classes by rules, visual records, stored logs and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import visual
from millrace.operators import reading
from millrace.plans.lineage import ZONES_SQL, _digit, zones
from millrace.plans.registry import AS_OF, exact, query, table
from millrace.sources import tables


@query(
    "near_line_crossings",
    """WITH s AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS at, l_partkey % 640 AS x1, l_orderkey % 480 AS y1, l_suppkey * 7 % 640 AS x2, l_linenumber * 97 % 480 AS y2 FROM lineitem),
    a AS (SELECT *, abs(atan2(y2 - y1, x2 - x1)) AS steep FROM s),
    p AS (SELECT a.l_suppkey, count(*) AS crossed FROM a JOIN a AS b ON a.l_suppkey = b.l_suppkey AND b.at > a.at AND b.at < a.at + 20 WHERE degrees(abs(a.steep - b.steep)) > 10 AND degrees(abs(a.steep - b.steep)) < 170 GROUP BY ALL)
    SELECT g.l_suppkey, coalesce(crossed, 0) AS crossed, round(least(1.0, coalesce(crossed, 0) / 8000), 6)::DOUBLE AS score FROM (SELECT DISTINCT l_suppkey FROM lineitem) AS g LEFT JOIN p USING (l_suppkey)""",
)
def near_line_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's lines as segments: pairs less than 20 apart that cross."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey"))
    s = table(spark, sf_dir, "lineitem").select("l_suppkey", at.alias("at"), (F.col("l_partkey") % 640).alias("x1"), (F.col("l_orderkey") % 480).alias("y1"), (F.col("l_suppkey") * 7 % 640).alias("x2"), (F.col("l_linenumber") * 97 % 480).alias("y2"))
    found = reading.crossings(s, ["l_suppkey"], "at", F.lit(6400), F.lit(4800))
    return found.select("l_suppkey", "crossed", exact("score").alias("score"))


_MAIL, _NUMBER = r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", r"[0-9][0-9 .-]{6,}[0-9]"


@query(
    "staged_reading",
    f"""WITH found AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{_MAIL}') AS mails, regexp_extract_all(coalesce(text, ''), '{_NUMBER}') AS numbers FROM documents),
    results AS (
        SELECT doc_id, 1 AS place, 'mail' AS stage, unnest(mails) AS value, len(mails) AS n FROM found
        UNION ALL SELECT doc_id, 2, 'number', unnest(numbers), len(numbers) FROM found WHERE len(mails) = 0
        UNION ALL SELECT doc_id, 3, 'start', substr(text, 1, 12), 1 FROM found WHERE len(mails) = 0 AND len(numbers) = 0 AND length(text) > 0),
    scored AS (SELECT *, least(length(value), 40) / 40.0 * 0.6 + CASE WHEN contains(value, '.') THEN 0.4 ELSE 0 END + least(n / 3, 1.0) * 0.1 AS score FROM results),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, value) AS rank FROM scored)
    SELECT d.doc_id, coalesce(stage, '') AS stage, coalesce(place > 1, false) AS fallback, coalesce(value, '') AS value, round(coalesce(score, 0), 6)::DOUBLE AS score
    FROM documents AS d LEFT JOIN ranked AS r ON r.doc_id = d.doc_id AND rank = 1""",
)
def staged_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses where there are any, else numbers, else how the text starts; documents without any of these too."""

    def every(pattern: str):
        def stage(rows: DataFrame) -> DataFrame:
            found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
            each = rows.select("doc_id", F.size(found).alias("n"), F.explode(found).alias("value"))
            score = reading.reading_score(F.least(F.length("value"), F.lit(40)) / 40.0, F.col("value").contains("."), F.col("n"))
            return each.select("doc_id", "value", score.alias("score"))

        return stage

    def start(rows: DataFrame) -> DataFrame:
        value = F.substring("text", 1, 12)
        score = reading.reading_score(F.least(F.length(value), F.lit(40)) / 40.0, value.contains("."), F.lit(1))
        return rows.where(F.length("text") > 0).select("doc_id", value.alias("value"), score.alias("score"))

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    best, rest = reading.staged(docs, "doc_id", {"mail": every(_MAIL), "number": every(_NUMBER), "start": start}, order=("value",))
    none = rest.select("doc_id", F.lit("").alias("value"), F.lit(0.0).alias("score"), F.lit("").alias("stage"), F.lit(False).alias("fallback"))
    return best.unionByName(none).select("doc_id", "stage", "fallback", "value", exact("score").alias("score"))


@query(
    "aligned_confidence",
    f"""WITH {ZONES_SQL},
    lines AS (SELECT doc_id, fmt, 1 AS line, l1 AS text FROM zones UNION ALL SELECT doc_id, fmt, 2, l2 FROM zones UNION ALL SELECT doc_id, fmt, 3, l3 FROM zones WHERE l3 <> ''),
    spans AS (SELECT doc_id, line, k * 11 AS a, k * 11 + 9 + (doc_id + k) % 4 AS z, ((doc_id * 7 + line * 13 + k * 29) % 100) / 100.0 AS c FROM lines, range(4) AS t(k) WHERE (doc_id + line + k) % 5 <> 0),
    named AS (SELECT *, substr(text, 6, CASE fmt WHEN 'TD3' THEN 39 WHEN 'TD2' THEN 31 ELSE 25 END) AS names FROM lines),
    cut AS (SELECT *, CASE WHEN position('<<' IN names) > 0 THEN position('<<' IN names) - 1 ELSE length(names) END AS n FROM named),
    fields AS (
        SELECT doc_id, 'issuing_country' AS field, line, 2 AS a, 5 AS z, substr(text, 3, 3) AS raw FROM cut WHERE line = 1
        UNION ALL SELECT doc_id, 'surname', line, 5, 5 + n, substr(names, 1, n) FROM cut WHERE line = 1
        UNION ALL SELECT doc_id, 'given_name', line, least(5 + n + 2, 5 + length(names)), 5 + length(names), substr(names, n + 3) FROM cut WHERE line = 1
        UNION ALL SELECT doc_id, 'full_name', line, 5, 5 + length(names), names FROM cut WHERE line = 1
        UNION ALL SELECT doc_id, f.name, line, f.a, f.z, substr(text, f.a + 1, f.z - f.a) FROM cut, (VALUES ('passport_number', 0, 9), ('nationality', 10, 13), ('date_of_birth', 13, 19), ('gender', 20, 21), ('expiry_date', 21, 27)) AS f(name, a, z) WHERE line = 2
        UNION ALL SELECT doc_id, 'optional_data', line, 28, CASE fmt WHEN 'TD3' THEN 42 WHEN 'TD2' THEN 35 ELSE 30 END, substr(text, 29, CASE fmt WHEN 'TD3' THEN 14 WHEN 'TD2' THEN 7 ELSE 2 END) FROM cut WHERE line = 2
        UNION ALL SELECT doc_id, 'optional_data', line, 0, 30, text FROM cut WHERE line = 3),
    met AS (SELECT f.doc_id, field, f.line, any_value(raw) AS raw, sum(greatest(least(greatest(f.z, f.a + 1), s.z) - greatest(f.a, s.a), 0) * s.c) AS total, sum(greatest(least(greatest(f.z, f.a + 1), s.z) - greatest(f.a, s.a), 0)) AS n
            FROM fields AS f LEFT JOIN spans AS s ON s.doc_id = f.doc_id AND s.line = f.line GROUP BY ALL),
    whole AS (SELECT doc_id, field, string_agg(raw, '' ORDER BY line) AS raw, avg(CASE WHEN n > 0 THEN total / n ELSE 0 END) AS mean FROM met GROUP BY ALL)
    SELECT doc_id, field, length(replace(raw, '<', ''))::INT AS letters, round(CASE WHEN trim(replace(raw, '<', '')) = '' THEN greatest(mean - 0.3, 0) ELSE mean END, 9)::DOUBLE AS confidence FROM whole""",
)
def aligned_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of varied lengths with gaps over zones in three formats."""
    lines = zones(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("at", "text")).where("text is not null and text <> '  '")
    # The blank line between the first and second is none.
    lines = lines.select("doc_id", F.when(F.col("at") == 0, 1).otherwise(F.col("at")).cast("int").alias("line"), "text")
    k, at = F.col("k"), F.col("doc_id") + F.col("k")
    spans = lines.select("doc_id", "line", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).where((at + F.col("line")) % 5 != 0)
    spans = spans.select("doc_id", "line", (k * 11).alias("start"), (k * 11 + 9 + at % 4).alias("end"), ((F.col("doc_id") * 7 + F.col("line") * 13 + k * 29) % 100 / 100.0).alias("confidence"))
    found = reading.aligned_confidence(lines, spans, "doc_id")
    kept = F.when(F.col("field").isin("surname", "given_name", "full_name") | F.col("value").contains(" "), F.length(F.replace("value", F.lit(" "), F.lit("")))).otherwise(F.length(F.replace("value", F.lit("<"), F.lit(""))))
    return found.select("doc_id", "field", kept.alias("letters"), exact("confidence", 9).alias("confidence"))


@query(
    "text_lines_of_boxes",
    """WITH b AS (SELECT l_suppkey AS page, l_orderkey, l_linenumber, (l_partkey % 300)::DOUBLE AS left_at, (l_orderkey % 400) * 3.0 AS top, (l_orderkey % 400) * 3.0 + 2 + l_linenumber AS bottom,
               CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE (l_linenumber * 31 + l_partkey) % 100 / 100.0 END AS confidence, lower(l_returnflag) || ' -' || l_partkey || '<' AS word FROM lineitem),
    h AS (SELECT page, greatest(list_sort(list(bottom - top))[floor(count(*) / 2)::INT + 1] * 0.6, 3.0) AS tolerance FROM b GROUP BY page),
    m AS (SELECT b.*, (top + bottom) / 2 AS middle, tolerance FROM b JOIN h USING (page)),
    f AS (SELECT *, CASE WHEN middle - lag(middle) OVER (PARTITION BY page ORDER BY middle, l_orderkey, l_linenumber) > tolerance THEN 1 ELSE 0 END AS fresh FROM m),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY middle, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) + 1 AS line FROM f),
    t AS (SELECT page, line, regexp_replace(upper(string_agg(word, '' ORDER BY left_at, l_orderkey, l_linenumber)), '[^A-Z0-9<]', '', 'g') AS text, avg(confidence) AS confidence FROM n WHERE confidence >= 0.5 GROUP BY ALL)
    SELECT page, line::BIGINT AS line, text, round(confidence, 6)::DOUBLE AS confidence FROM t WHERE length(text) >= 15""",
)
def text_lines_of_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's lines as boxes on a page."""
    li = table(spark, sf_dir, "lineitem")
    top = (F.col("l_orderkey") % 400) * 3.0
    confidence = F.when(F.col("l_orderkey") % 7 != 0, (F.col("l_linenumber") * 31 + F.col("l_partkey")) % 100 / 100.0)
    word = F.concat(F.lower("l_returnflag"), F.lit(" -"), F.col("l_partkey").cast("string"), F.lit("<"))
    boxes = li.select(F.col("l_suppkey").alias("page"), "l_orderkey", "l_linenumber", (F.col("l_partkey") % 300).cast("double").alias("left"), top.alias("top"), (top + 2 + F.col("l_linenumber")).alias("bottom"), confidence.alias("confidence"), word.alias("text"))
    found = reading.lines_of_boxes(boxes, ["page"], order=("l_orderkey", "l_linenumber"))
    return found.select("page", "line", "text", exact("confidence").alias("confidence"))


@query(
    "profile_line_counts",
    """WITH s AS (SELECT user_id, event_id, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM events),
    r AS (SELECT *, sum(CASE WHEN coalesce(smooth >= 50, false) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM s),
    g AS (SELECT user_id, run FROM r WHERE smooth >= 50 GROUP BY ALL HAVING count(*) >= 2)
    SELECT u.user_id, count(g.run) AS lines FROM (SELECT DISTINCT user_id FROM events) AS u LEFT JOIN g USING (user_id) GROUP BY ALL""",
)
def profile_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values in order as a profile: smoothed over three, runs of two and more."""
    return reading.line_runs(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 50.0, 2)


#: What speaks for a passport and for a card, in hundredths; bounds are exclusive.
LAYOUT_RULES = [
    ("PASSPORT", 1, "ASPECT_RATIO_PASSPORT", "ratio", 1.3, 1.8, 30),
    ("PASSPORT", 1, "DENSE_TEXT_BOTTOM", "bottom_share", 0.1, None, 30),
    ("PASSPORT", 1, "LARGE_TEXT_TOP", "top_share", None, 0.8, 20),
    ("ID_CARD", 2, "ASPECT_RATIO_ID_CARD", "ratio", 1.4, 1.8, 20),
    ("ID_CARD", 2, "LOW_EDGE_DENSITY", "edge_density", None, 0.15, 15),
    ("ID_CARD", 2, "BALANCED_WHITE_RATIO", "white_ratio", 0.4, 0.8, 15),
]


def layout_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LAYOUT_RULES, "label string, place int, signal string, feature string, low double, high double, points int")


@query(
    "document_classes",
    """WITH f AS (SELECT o_orderkey, 1 + (o_orderkey % 10) / 10.0::DOUBLE AS r, (o_custkey % 8) / 40.0::DOUBLE AS b, (o_custkey % 100) / 100.0::DOUBLE AS t, (o_orderkey % 40) / 100.0::DOUBLE AS e, (o_custkey * 7 % 100) / 100.0::DOUBLE AS w,
               CASE o_orderkey % 17 WHEN 0 THEN 'PASSPORT' WHEN 1 THEN 'UNKNOWN' END AS forced FROM orders),
    p AS (SELECT *, CASE WHEN r > 1.3 AND r < 1.8 THEN 30 ELSE 0 END + CASE WHEN b > 0.1 THEN 30 ELSE 0 END + CASE WHEN t < 0.8 THEN 20 ELSE 0 END AS p,
               CASE WHEN r > 1.4 AND r < 1.8 THEN 20 ELSE 0 END + CASE WHEN e < 0.15 THEN 15 ELSE 0 END + CASE WHEN w > 0.4 AND w < 0.8 THEN 15 ELSE 0 END AS c FROM f),
    k AS (SELECT *, CASE WHEN forced IS NOT NULL THEN forced WHEN p >= 30 AND p >= c THEN 'PASSPORT' WHEN c >= 30 THEN 'ID_CARD' ELSE 'UNKNOWN' END AS label FROM p)
    SELECT o_orderkey, label, CASE WHEN forced IS NOT NULL THEN 100 WHEN label = 'PASSPORT' THEN p WHEN label = 'ID_CARD' THEN c ELSE 0 END::INT AS points,
        round(CASE WHEN forced IS NOT NULL THEN 1 WHEN label = 'UNKNOWN' THEN 0 ELSE CASE label WHEN 'PASSPORT' THEN p ELSE c END / (CASE WHEN p >= 30 THEN p ELSE 0 END + CASE WHEN c >= 30 THEN c ELSE 0 END) END, 6)::DOUBLE AS share,
        CASE WHEN forced IS NOT NULL THEN 'FORCED_MODE' WHEN label = 'PASSPORT' THEN concat_ws(';', CASE WHEN r > 1.3 AND r < 1.8 THEN 'ASPECT_RATIO_PASSPORT' END, CASE WHEN b > 0.1 THEN 'DENSE_TEXT_BOTTOM' END, CASE WHEN t < 0.8 THEN 'LARGE_TEXT_TOP' END)
             WHEN label = 'ID_CARD' THEN concat_ws(';', CASE WHEN r > 1.4 AND r < 1.8 THEN 'ASPECT_RATIO_ID_CARD' END, CASE WHEN w > 0.4 AND w < 0.8 THEN 'BALANCED_WHITE_RATIO' END, CASE WHEN e < 0.15 THEN 'LOW_EDGE_DENSITY' END) ELSE '' END AS signals FROM k""",
)
def document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's measures as those of a picture, some with a forced class."""
    mode = F.when(F.col("o_orderkey") % 17 == 0, "PASSPORT").when(F.col("o_orderkey") % 17 == 1, "UNKNOWN")
    f = table(spark, sf_dir, "orders").select(
        "o_orderkey", (1 + F.col("o_orderkey") % 10 / 10.0).alias("ratio"), (F.col("o_custkey") % 8 / 40.0).alias("bottom_share"), (F.col("o_custkey") % 100 / 100.0).alias("top_share"), (F.col("o_orderkey") % 40 / 100.0).alias("edge_density"), (F.col("o_custkey") * 7 % 100 / 100.0).alias("white_ratio"), mode.alias("mode")
    )
    found = reading.classified(f, ["o_orderkey"], layout_rules(spark), ["ratio", "bottom_share", "top_share", "edge_density", "white_ratio"], forced="mode")
    return found.select("o_orderkey", F.coalesce("label", F.lit("UNKNOWN")).alias("label"), "points", exact("share").alias("share"), F.array_join("signals", ";").alias("signals"))


def visual_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, script: a page of labels, some with the value behind, some on the next line, over a document's first words; a third with a zone."""
    z = zones(spark, sf_dir).where("fmt = 'TD3'").select("doc_id", F.element_at("lines", 1).alias("l1"), F.element_at("lines", 3).alias("l2"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment", "c_name")
    k = F.col("doc_id")
    name = F.when(k % 5 == 0, "Иванова").when(k % 5 == 1, F.concat(F.lit("O'"), F.lower("c_mktsegment"))).otherwise(F.col("c_mktsegment"))
    lines = F.concat_ws(
        "\n",
        F.lit("republic of utopia"),
        F.when(k % 4 == 0, F.concat(F.lit("Surname: "), name)).when(k % 4 == 1, F.concat(F.lit("Ho / Surname"), F.lit("\n"), F.col("c_mktsegment"))).when(k % 4 == 2, F.concat(F.lit("surname: s\nNachname  "), name)),
        F.when(k % 3 == 0, F.concat(F.lit("Given names  "), F.lower("c_name"))).when(k % 3 == 1, F.concat(F.lit("PRENOM\n"), F.lower("c_mktsegment"), F.lit(" 7 Ann"))),
        F.when(k % 7 == 0, F.concat(F.lit("Passport No ab 12"), k.cast("string"))).when(k % 7 < 4, F.concat(F.lit("Document no. x"), F.lpad(k.cast("string"), 7, "0"))),
        F.when(k % 6 == 0, "Nationality: UTO").when(k % 6 == 1, "Nacionalidad utopian\nNationality GBR"),
        F.when(k % 8 < 3, F.concat(F.lit("Date of birth: 1"), (k % 10).cast("string"), F.lit("/02/1980"))).when(k % 8 < 6, "Geburtsdatum\n  3-4-77 or so"),
        F.when(k % 2 == 0, F.concat(F.lit("Date of expiry 2031."), (k % 12 + 1).cast("string"))),
    )
    whole = F.when(F.col("l1").isNotNull() & (k % 2 == 0), F.concat_ws("\n", lines, F.lower("l1"), "l2")).otherwise(lines)
    return c.join(z, "doc_id", "left").select("doc_id", whole.alias("text"), F.when(k % 10 == 0, "CYRILLIC").otherwise("LATIN").alias("script"))


def _label_sql(name: str) -> str:
    """What a line, in capitals, gives for a field behind its first label, else null."""

    def taken(v: str) -> str:
        if name == "passport_number":
            cleaned = f"regexp_replace(trim({v}), '[^A-Z0-9]', '', 'g')"
            return f"CASE WHEN length({cleaned}) >= 6 THEN {cleaned} END"
        if name in ("surname", "given_name"):
            cleaned = f"trim(regexp_replace(trim({v}), '[^A-Z a-zÀ-ÿ]', '', 'g'))"
            return f"CASE WHEN upper({cleaned}) NOT IN ('', 'S', 'NAME', 'NAMES') THEN {cleaned} END"
        return f"CASE WHEN length(trim({v})) <= 5 THEN trim({v}) END" if name == "nationality" else f"trim({v})"

    quoted = [p.replace("'", "''") for p in visual.PATTERNS[name]]
    by_label = "CASE " + " ".join(f"WHEN regexp_matches(up, '{p}') THEN {taken(f"regexp_extract(up, '{p}', 1)")}" for p in quoted) + " END"
    if name not in visual.ALONE:
        return by_label
    alone = " OR ".join(f"regexp_matches(up, '{p}')" for p in visual.ALONE[name])
    cleaned = "regexp_replace(following, '[^A-Z ]', '', 'g')"
    value = f"nullif(regexp_extract(following, '{visual.NEXT_DATE}', 1), '')" if name == "date_of_birth" else f"CASE WHEN length({cleaned}) BETWEEN 1 AND 30 THEN {cleaned} END"
    return f"coalesce({by_label}, CASE WHEN {alone} THEN {value} END)"


def _first_sql(name: str) -> str:
    return f"coalesce(arg_min(f_{name}, pos) FILTER (f_{name} IS NOT NULL), '') AS {name}"


def _single_sql(v: str, width: int, told: str) -> str:
    """v with the first single swap that makes its digit hold."""
    made = f"list_transform(range({width}), lambda j: substr({v}, 1, j) || translate(substr({v}, j + 1, 1), 'O0I1B8S5Z2', '0O1I8B5S2Z') || substr({v}, j + 2))"
    return f"CASE WHEN {told} = '<' OR {_digit(v)} = {told} THEN {v} ELSE coalesce(list_filter({made}, lambda x: x <> {v} AND {_digit('x')} = {told})[1], {v}) END"


def _words_sql(v: str) -> str:
    distinct = "len(list_distinct(string_split(x, '')))"
    return f"array_to_string(list_filter(string_split({v}, ' '), lambda x: regexp_full_match(x, '[A-Z]{{1,15}}') AND {distinct} > 1 AND NOT ({distinct} < 3 AND length(x) > 3)), ' ')"


def _day_sql(v: str) -> str:
    return f"coalesce(strftime(try_strptime(CASE WHEN regexp_full_match({v}, '[0-9]{{6}}') THEN {v} END, '%y%m%d'), '%Y-%m-%d'), '')"


_ZONE_TOLD = {"surname": "msur", "given_name": "mgiv", "full_name": "trim(msur || ' ' || mgiv)", "passport_number": "rtrim(mnum, '<')", "nationality": "replace(substr(l2, 11, 3), '<', '')", "date_of_birth": _day_sql("mborn"), "expiry_date": _day_sql("mends")}
_CYRILLIC = "translate(replace(upper({0}), 'Я', 'IA'), 'ИВАНО', 'IVANO')"


@query(
    "visual_records",
    f"""WITH {ZONES_SQL},
    c AS (SELECT c_custkey AS doc_id, c_mktsegment AS seg, c_name, c_custkey AS k FROM customer),
    named AS (SELECT *, CASE k % 5 WHEN 0 THEN 'Иванова' WHEN 1 THEN 'O''' || lower(seg) ELSE seg END AS name FROM c),
    body AS (SELECT *, concat_ws(chr(10), 'republic of utopia', CASE k % 4 WHEN 0 THEN 'Surname: ' || name WHEN 1 THEN 'Ho / Surname' || chr(10) || seg WHEN 2 THEN 'surname: s' || chr(10) || 'Nachname  ' || name END,
        CASE k % 3 WHEN 0 THEN 'Given names  ' || lower(c_name) WHEN 1 THEN 'PRENOM' || chr(10) || lower(seg) || ' 7 Ann' END,
        CASE WHEN k % 7 = 0 THEN 'Passport No ab 12' || k WHEN k % 7 < 4 THEN 'Document no. x' || lpad(k::VARCHAR, 7, '0') END,
        CASE k % 6 WHEN 0 THEN 'Nationality: UTO' WHEN 1 THEN 'Nacionalidad utopian' || chr(10) || 'Nationality GBR' END,
        CASE WHEN k % 8 < 3 THEN 'Date of birth: 1' || (k % 10) || '/02/1980' WHEN k % 8 < 6 THEN 'Geburtsdatum' || chr(10) || '  3-4-77 or so' END,
        CASE WHEN k % 2 = 0 THEN 'Date of expiry 2031.' || (k % 12 + 1) END) AS labels FROM named),
    texts AS (SELECT b.doc_id, k, CASE WHEN fmt = 'TD3' AND k % 2 = 0 THEN concat_ws(chr(10), labels, lower(l1), l2) ELSE labels END AS text FROM body AS b LEFT JOIN zones AS z ON z.doc_id = b.doc_id),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts),
    ups AS (SELECT *, upper(trim(line)) AS up, lead(upper(trim(line))) OVER (PARTITION BY doc_id ORDER BY pos) AS following, regexp_replace(upper(line), '[^A-Z0-9<]', '', 'g') AS z1 FROM lines),
    cands AS (SELECT *, {", ".join(f"{_label_sql(n)} AS f_{n}" for n in visual.PATTERNS)}, lead(z1) OVER (PARTITION BY doc_id ORDER BY pos) AS z2 FROM ups),
    firsts AS (SELECT doc_id, {", ".join(_first_sql(n) for n in visual.PATTERNS)} FROM cands GROUP BY doc_id),
    pairs AS (SELECT doc_id, pos, rpad(z1, 44, '<') AS l1, rpad(z2, 44, '<') AS l2, CASE WHEN z1 LIKE 'P<%' THEN 30 WHEN z1 LIKE 'P%' AND length(z1) > 2 THEN 10 ELSE 0 END + CASE WHEN length(regexp_replace(z1, '[^<]', '', 'g')) >= 5 THEN 10 ELSE 0 END
        + CASE WHEN length(z1) >= 40 THEN 20 ELSE 0 END + CASE WHEN length(z2) >= 40 THEN 20 ELSE 0 END + CASE WHEN length(regexp_replace(z2, '[^0-9]', '', 'g')) >= 10 THEN 15 ELSE 0 END AS points FROM cands WHERE length(z1) >= 20 AND length(z2) >= 20),
    best AS (SELECT * FROM pairs WHERE points > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, pos) = 1),
    told AS (SELECT doc_id, l1, l2, substr(l1, 6) AS names, {_single_sql("substr(l2, 1, 9)", 9, "substr(l2, 10, 1)")} AS mnum, {_single_sql("substr(l2, 14, 6)", 6, "substr(l2, 20, 1)")} AS mborn, {_single_sql("substr(l2, 22, 6)", 6, "substr(l2, 28, 1)")} AS mends FROM best),
    parsed AS (SELECT *, trim(regexp_replace(replace(CASE WHEN position('<<' IN names) > 0 THEN substr(names, 1, position('<<' IN names) - 1) ELSE names END, '<', ' '), ' +', ' ', 'g')) AS msur,
        trim(regexp_replace(replace(CASE WHEN position('<<' IN names) > 0 THEN substr(names, position('<<' IN names) + 2) ELSE '' END, '<', ' '), ' +', ' ', 'g')) AS mgiv FROM told),
    own AS (SELECT f.*, k, CASE WHEN surname <> '' AND given_name <> '' THEN surname || ' ' || given_name ELSE surname END AS full_name FROM firsts AS f JOIN texts USING (doc_id)),
    latin AS (SELECT * REPLACE ({", ".join(f"CASE WHEN k % 10 = 0 AND regexp_matches({n}, '[^\x00-\x7F]') THEN {_CYRILLIC.format(n)} ELSE {n} END AS {n}" for n in ("surname", "given_name", "full_name"))}) FROM own),
    laid AS (SELECT l.*, p.doc_id IS NOT NULL AND (msur <> '' OR rtrim(mnum, '<') <> '') AS zone_found, p.* EXCLUDE (doc_id) FROM latin AS l LEFT JOIN parsed AS p ON p.doc_id = l.doc_id)
    SELECT doc_id, {", ".join(f"CASE WHEN zone_found AND {told} <> '' THEN {_words_sql(told) if n in ('surname', 'given_name', 'full_name') else told} ELSE {n} END AS {n}" for n, told in _ZONE_TOLD.items())},
        CASE WHEN zone_found AND substr(l2, 21, 1) IN ('M', 'F') THEN substr(l2, 21, 1) ELSE 'UNKNOWN' END AS gender, zone_found FROM laid""",
)
def visual_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of labels in several languages, half of the passports' with their zone."""
    found = reading.visual_records(visual_texts(spark, sf_dir), "text", "script")
    return found.select("doc_id", "record.*")


@query("expired_log", "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-04-01 07:30:00' - INTERVAL 80 DAYS")
def expired_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in a log by day, then cleared of what is older than eighty days."""
    path, events = tables.shared_path(spark, "event-log"), table(spark, sf_dir, "events")
    tables.write_log(events, path)
    tables.expire(spark, path, "2024-04-01 07:30:00", 80)
    return tables.read_log(spark, path, events).select("event_id", "user_id", "event_type")


@query("keyed_lookups", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 77")
def keyed_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers laid out by key: all of one segment by the index, and one by its key."""
    path = tables.shared_path(spark, "customers")
    tables.write_keyed(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, "c_custkey", 16, ("c_mktsegment",))
    one = tables.by_key(spark, path, "c_custkey", 77, 16)
    return tables.by_index(spark, path, "c_mktsegment", "BUILDING", 16).unionByName(one)


@query(
    "collated_names",
    """WITH n AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN 'Éa' || c_mktsegment ELSE 'éb' || lower(c_mktsegment) END AS shown FROM customer)
    SELECT c_custkey, shown, row_number() OVER (ORDER BY lower(strip_accents(shown)), c_custkey) AS place FROM n QUALIFY place BETWEEN 11 AND 60""",
)
def collated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of names as a reader orders them: capitals and marks do not part them."""
    from millrace.operators.audit import page
    from millrace.operators.reading import collated

    k = F.col("c_custkey")
    shown = F.when(k % 4 == 0, F.col("c_name")).when(k % 4 == 1, F.lower("c_mktsegment")).when(k % 4 == 2, F.concat(F.lit("Éa"), "c_mktsegment")).otherwise(F.concat(F.lit("éb"), F.lower("c_mktsegment")))
    t = table(spark, sf_dir, "customer").select(k, shown.alias("shown"))
    found = page(t, [collated(F.col("shown"), marks=False), k], 10, 50)
    # A page is at most 50 rows.
    from pyspark.sql import Window

    return found.withColumn("place", (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(collated(F.col("shown"), marks=False), "c_custkey")) + 10).cast("long"))
