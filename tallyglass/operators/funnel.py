"""Ordered funnels: how far users come through steps in time order, each within a limit of the one before."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.skew import HOT_ROWS, time_chunks


def step_depths(
    events: DataFrame, user: str, ts: str, steps: Mapping[str, Column], within_seconds: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Events of the first step with the number of steps reached from each: ``user``, ``ts`` in microseconds, ``depth``.

    A step counts if one of its events is later than the step before's event, by at most the limit.  Of each user and instant
    there is one row, whatever number of events it had.  From the last step back, the depth of an event is one more than the
    largest of the next step's events within the limit after it: one sort serves all steps.  A hot user's time is cut into
    chunks, each with what follows it as far as a whole funnel can reach.  Events without user or time count for nothing.
    """
    names = list(steps)
    reach = within_seconds * 1_000_000
    flags = [F.coalesce(cond, F.lit(False)).alias(f"_is{i}") for i, cond in enumerate(steps.values())]
    timed = events.select(F.col(user).alias("user"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), *flags)
    any_step = F.greatest(*[F.col(f"_is{i}") for i in range(len(names))]) if len(names) > 1 else F.col("_is0")
    used = timed.filter(any_step & F.col("user").isNotNull() & F.col("_at").isNotNull())
    instants = used.groupBy("user", "_at").agg(*[F.bool_or(f"_is{i}").alias(f"_is{i}") for i in range(len(names))])
    rows = time_chunks(instants, "user", "_at", after=reach * (len(names) - 1), threshold=hot_rows)
    ahead = Window.partitionBy("user", "_chunk").orderBy("_at").rangeBetween(1, reach)
    for i in reversed(range(len(names))):
        further = F.lit(0) if i == len(names) - 1 else F.coalesce(F.max(f"_depth{i + 1}").over(ahead), F.lit(0))
        rows = rows.withColumn(f"_depth{i}", F.when(F.col(f"_is{i}"), further + 1))
    return rows.filter("_own and _is0").select("user", "_at", F.col("_depth0").alias("depth"))


def ordered_funnel(
    events: DataFrame,
    user: str,
    ts: str,
    steps: Mapping[str, Column],
    within_seconds: int,
    period: Column | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Users per step, and the part of the first step's users that reach the last: never above 1.

    ``period`` is an expression of the first step's time, column ``ts`` here, by which users are counted.  Every user counts
    once per period, with the furthest step reached from one of the period's events.
    """
    depths = step_depths(events, user, ts, steps, within_seconds, hot_rows)
    timed = depths.select("user", F.timestamp_micros("_at").alias("ts"), "depth")
    by = [] if period is None else [period.alias("period")]
    furthest = timed.groupBy("user", *by).agg(F.max("depth").alias("_depth"))
    users = [F.count_if(F.col("_depth") > i).alias(f"{name}_users") for i, name in enumerate(steps)]
    counted = furthest.groupBy(*(["period"] if by else [])).agg(*users)
    first, last = list(steps)[0], list(steps)[-1]
    return counted.withColumn("rate", F.try_divide(F.col(f"{last}_users").cast("double"), F.col(f"{first}_users")))
