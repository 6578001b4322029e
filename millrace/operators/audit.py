"""Event logs: queries by type, time and session, pages, retention and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit_query(events: DataFrame, types: list[str] | None = None, start: str | None = None, end: str | None = None, session: object = None, ts: str = "ts", kind: str = "event_type", session_col: str = "user_id") -> DataFrame:
    """Events of the types, from start to end inclusive, of the session; what is not given does not restrict. The bounds reach the scan."""
    if types:
        events = events.where(F.col(kind).isin(types))
    for bound, test in ((start, lambda c, b: c >= b), (end, lambda c, b: c <= b)):
        if bound:
            events = events.where(test(F.col(ts), F.lit(bound).cast(events.schema[ts].dataType)))
    return events if session is None else events.where(F.col(session_col) == session)


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of an ordered result; limit 0 or less gives all that follows offset. Order by a unique key last."""
    ordered = rows.orderBy(*order).offset(offset)
    return ordered.limit(limit) if limit > 0 else ordered


def retain(events: DataFrame, as_of: str, days: int = 90, entries: int = 10_000, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """Events no older than so many days before as_of, and of those the newest so many: a bounded top-k, no ranking of the whole log in one task."""
    cutoff = F.lit(as_of).cast(events.schema[ts].dataType) - F.expr(f"INTERVAL {days} DAYS")
    return events.where(F.col(ts) >= cutoff).orderBy(F.col(ts).desc(), F.col(key).desc()).limit(entries)


def csv_line(*values: Column, quoted: bool = True) -> Column:
    """A CSV line. quoted: values with a comma, quote or line feed stand in quotes, quotes doubled; otherwise plainly joined."""

    def one(v: Column) -> Column:
        s = F.coalesce(v.cast("string"), F.lit(""))
        if not quoted:
            return s
        return F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return F.concat_ws(",", *map(one, values))


def cap_per_session(artifacts: DataFrame, session: str, order: list[Column], cap: int = 100) -> DataFrame:
    """The first cap artifacts of each session: rank, then filter, which Spark cuts before the shuffle."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(session).orderBy(*order))
    return artifacts.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")
