"""Event streams: an append-only masked log, windowed counts, and the first so many of a session."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from millrace.functions.masks import mask_middle


def masked_log(events: DataFrame, sensitive: list[str]) -> DataFrame:
    """The stream with sensitive columns masked: no state, any mode."""
    return events.withColumns({c: mask_middle(F.col(c).cast("string")) for c in sensitive})


def append_log(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, appended as Parquet exactly once, then the query ends."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, kind: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and kind; windows close when the watermark has passed them."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def first_of_session(events: DataFrame, session: str, columns: str, cap: int = 100, ttl: str | None = "7 days") -> DataFrame:
    """The first cap rows of each session as they come: the state is a count, kept for ttl behind the last row.

    With a ttl the query runs batches without data to see what has expired, so an availableNow trigger never
    ends; without one (None) the state stays and it does.

    columns: the schema of the rows that go on, session first.
    """
    names = [c.strip().split(" ")[0] for c in columns.split(",")]
    keep_ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else 0

    def run(key: Any, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        for frame in frames:
            room = max(0, cap - seen)
            seen += len(frame)
            if room:
                yield frame[names].head(room)
        state.update((seen,))
        if ttl:
            state.setTimeoutDuration(keep_ms)

    return events.groupBy(session).applyInPandasWithState(run, columns, "seen long", "append", GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout)
