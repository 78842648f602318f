"""Batch sessionization and session statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def sessionize_batch(
    events: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int
) -> DataFrame:
    """Sessions per key: start, last event and number of hits.

    A session ends where the next event is more than the gap away.  Events are
    first reduced to one row per key and gap-wide time slot: two events in one
    slot are always in one session.  That aggregate combines on the map side,
    and after it a key has at most (time span / gap) rows, so the window over a
    key is bounded however many events the key has.
    """
    gap = gap_seconds * MICROS
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    slots = (
        events.filter(F.col(ts).isNotNull())
        .select(*keys, F.col(ts).alias("_ts"), (micros - F.pmod(micros, F.lit(gap))).alias("_slot"))
        .groupBy(*keys, "_slot")
        .agg(F.min("_ts").alias("_first"), F.max("_ts").alias("_last"), F.count(F.lit(1)).alias("_hits"))
    )
    by_time = Window.partitionBy(*keys).orderBy("_slot")
    first_us = F.unix_micros(F.col("_first").cast("timestamp"))
    last_us = F.unix_micros(F.col("_last").cast("timestamp"))
    opens = F.when(first_us - F.lag(last_us).over(by_time) <= gap, 0).otherwise(1)
    running = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        slots.withColumn("_opens", opens)
        .withColumn("_session", F.sum("_opens").over(running))
        .groupBy(*keys, "_session")
        .agg(
            F.min("_first").alias("session_start"),
            F.max("_last").alias("session_last"),
            F.sum("_hits").alias("num_hits"),
        )
        .drop("_session")
    )


def session_avg(sessions: DataFrame, host: str, suffix: str, name: str = "average_events_per_session") -> DataFrame:
    """Average hits per session over hosts ending in ``suffix``."""
    return sessions.filter(F.col(host).endswith(suffix)).agg(F.avg("num_hits").alias(name))


def session_compare(sessions: DataFrame, host: str, hosts: Sequence[str], sort: bool = True) -> DataFrame:
    """Average hits, sessions and total hits of each listed host."""
    compared = (
        sessions.filter(F.col(host).isin(*hosts))
        .groupBy(host)
        .agg(
            F.avg("num_hits").alias("average_events_per_session"),
            F.count(F.lit(1)).alias("total_sessions"),
            F.sum("num_hits").alias("total_hits"),
        )
    )
    return compared.orderBy(host) if sort else compared


def session_check(events: DataFrame, sessions: DataFrame, ts: str) -> DataFrame:
    """One row: events with a time, hits over all sessions, and whether they agree."""
    seen = events.agg(F.count(ts).alias("event_count"), F.lit(0).cast("bigint").alias("session_hits"))
    counted = sessions.agg(
        F.lit(0).cast("bigint").alias("event_count"), F.coalesce(F.sum("num_hits"), F.lit(0)).cast("bigint").alias("session_hits")
    )
    both = seen.unionByName(counted).agg(F.sum("event_count").alias("event_count"), F.sum("session_hits").alias("session_hits"))
    return both.withColumn("agrees", F.col("event_count") == F.col("session_hits"))


def week_of(ts: str | Column) -> Column:
    """Monday of the week, as a date."""
    return F.to_date(F.date_trunc("week", ts))
