"""Queries over the event log, ordered lines and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import masks
from millrace.operators import audit, records, windows
from millrace.plans.registry import exact, query, stamp, table

START, END = "2024-01-05 00:00:00", "2024-01-20 00:00:00"


@query("audit_filter", f"SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'click') AND ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'")
def audit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_query(table(spark, sf_dir, "events"), ["error", "click"], START, END).select("event_id", "user_id", "event_type")


@query("audit_session", "SELECT event_id, event_type, value FROM events WHERE user_id = 7")
def audit_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_query(table(spark, sf_dir, "events"), session=7).select("event_id", "event_type", "value")


@query("audit_page", "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events WHERE event_type = 'error' ORDER BY events.ts DESC, event_id DESC LIMIT 50 OFFSET 20")
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit.audit_query(table(spark, sf_dir, "events"), ["error"])
    return audit.page(rows, [F.col("ts").desc(), F.col("event_id").desc()], 20, 50).select("event_id", "user_id", stamp(F.col("ts")).alias("ts"))


@query(
    "retention",
    "WITH kept AS (SELECT event_id, user_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts >= TIMESTAMP '2024-04-15 00:00:00' - INTERVAL 90 DAY) SELECT event_id, user_id FROM kept WHERE rn <= 10000",
)
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.retain(table(spark, sf_dir, "events"), "2024-04-15 00:00:00", 90, 10_000).select("event_id", "user_id")


@query(
    "audit_csv",
    """SELECT event_id, event_id || ',' || event_type || ',' || '"' || replace(props, '"', '""') || '"' AS quoted, event_id || ',' || event_type || ',' || props AS plain FROM events WHERE contains(props, '"')""",
)
def audit_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("props").contains('"'))
    return e.select("event_id", audit.csv_line(F.col("event_id"), F.col("event_type"), F.col("props")).alias("quoted"), audit.csv_line(F.col("event_id"), F.col("event_type"), F.col("props"), quoted=False).alias("plain"))


@query("event_details", "SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total, count(*) FILTER ((props->>'k')::INT >= 50) AS high FROM events GROUP BY ALL")
def event_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.count_if(k >= 50).alias("high"))


@query("session_caps", "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS rn FROM events) SELECT event_id, user_id FROM r WHERE rn <= 100")
def session_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.to_date("ts").alias("day"))
    return audit.cap_per_session(e, "day", [F.col("ts"), F.col("event_id")], 100).select("event_id", "user_id")


@query(
    "fill_log",
    """SELECT event_id, event_id || ',' || event_type || ',' || coalesce(substr(s_name, 1, 4) || repeat('*', length(s_name) - 4), '') AS line FROM events LEFT JOIN supplier ON user_id = s_suppkey""",
)
def fill_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their guests, masked, as plain lines; suppliers stand for guests, as there are fewer of them than users."""
    guests = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    joined = records.fill_log(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), guests, "user_id", "s_suppkey")
    return joined.select("event_id", audit.csv_line(F.col("event_id"), F.col("event_type"), masks.mask_start(F.col("s_name")), quoted=False).alias("line"))


@query(
    "moving_average",
    "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events",
)
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return windows.moving_average(e, ["user_id"], "event_id", "value", 5).select("event_id", exact(F.col("smooth")).alias("smooth"))


@query(
    "bands",
    """WITH m AS (SELECT *, sum(CASE WHEN value >= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)
    SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length, max(value) AS peak FROM m WHERE value >= 5 GROUP BY user_id, run HAVING count(*) >= 2""",
)
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.bands(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", "value", 5.0)


@query(
    "gap_sessions",
    """WITH l AS (SELECT user_id, event_id, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS fresh, ts FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1 AS session FROM l)
    SELECT user_id, session::BIGINT AS session, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL""",
)
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "ts")
    s = windows.sessions(e, ["user_id"], F.unix_micros(F.col("ts").cast("timestamp")), 3_600_000_000)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), exact(F.sum("value"), 4).alias("total"))


@query(
    "adjacent_turns",
    "WITH n AS (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations) SELECT role, following, count(*) AS n FROM n WHERE following IS NOT NULL GROUP BY ALL",
)
def adjacent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return windows.adjacent(c, ["conv_id"], ["turn"], "role").groupBy("role", "following").agg(F.count("*").alias("n"))


@query(
    "counts_before",
    """SELECT event_id, (count(*) FILTER (event_type = 'error') OVER w)::BIGINT AS errors, (count(*) FILTER (value > 5) OVER w)::BIGINT AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def counts_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return windows.counts_before(e, ["user_id"], ["ts", "event_id"], {"errors": F.col("event_type") == "error", "high": F.col("value") > 5}).select("event_id", "errors", "high")


@query(
    "neighbours",
    "SELECT event_id, coalesce(lag(event_id) OVER w, event_id) AS previous, coalesce(lead(event_id) OVER w, event_id) AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.neighbours(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "previous", "next")


@query(
    "upper_medians",
    "SELECT user_id, count(*) AS n, list_sort(list(value))[count(*) // 2 + 1] AS middle, round(greatest(list_sort(list(value))[count(*) // 2 + 1] * 0.6, 3.0), 6) AS tolerance FROM events GROUP BY user_id",
)
def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = windows.upper_medians(table(spark, sf_dir, "events"), ["user_id"], "value")
    return g.select("user_id", "n", "middle", exact(F.greatest(F.col("middle") * 0.6, F.lit(3.0))).alias("tolerance"))


@query(
    "best_of_group",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS rn FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE rn <= 3",
)
def best_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return windows.best(e, ["user_id", "event_type"], "value", ["event_id"], 3)


@query(
    "box_lines",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity AS x, l_returnflag AS t FROM lineitem),
    l AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY l_orderkey ORDER BY y, l_linenumber) > 10000 THEN 1 ELSE 0 END AS fresh FROM b),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY y, l_linenumber) + 1 AS line FROM l)
    SELECT l_orderkey, line::BIGINT AS line, string_agg(t, '' ORDER BY x, l_linenumber, t) AS text FROM g GROUP BY ALL""",
)
def box_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes grouped into lines by the gap between heights, each line's text from left to right."""
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"), F.col("l_returnflag").alias("t"))
    # The order breaks ties by line number, in the key's last digits.
    s = windows.sessions(b, ["l_orderkey"], F.col("y"), 10000.0, "line")
    words = F.array_sort(F.collect_list(F.struct("x", "l_linenumber", "t")))
    return s.groupBy("l_orderkey", "line").agg(F.array_join(F.transform(words, lambda w: w["t"]), "").alias("text"))
