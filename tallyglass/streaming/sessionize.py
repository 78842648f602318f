"""Event-time sessions over a stream of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessionize_stream(
    events: DataFrame,
    keys: Sequence[str] = ("ip", "host"),
    ts: str = "window_timestamp",
    gap: str = "5 minutes",
    delay: str = "15 seconds",
    start: str = "event_hour",
) -> DataFrame:
    """Hits per key and session, with the session's start.

    In append mode a session comes out once the watermark passes its end;
    events later than ``delay`` whose session has closed are dropped.  Sessions
    are merged inside each input partition first when the session sets
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition``.
    """
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("w"), *keys)
        .agg(F.count(keys[-1]).alias("num_hits"))
        .select(F.col("w.start").alias(start), *keys, "num_hits")
    )
