"""Monthly positional arrays: element i holds day i of the month."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.columns import set_position
from tallyglass.functions.joins import full_join


def daily_measures(
    events: DataFrame, keys: Sequence[str], day: Column, at, measures: Mapping[str, Column]
) -> DataFrame:
    """Measures per key on day ``at``."""
    rows = events.filter(day == F.lit(at).cast("date"))
    return rows.groupBy(*keys).agg(*[m.alias(name) for name, m in measures.items()]).withColumn(
        "date", F.lit(at).cast("date")
    )


def monthly_array_step(
    prev: DataFrame, daily: DataFrame, keys: Sequence[str], at, measures: Mapping[str, str],
    bucketed: bool = False,
) -> DataFrame:
    """The month's rows after day ``at``; ``measures`` maps daily columns to arrays.

    The day's value is written at its own position and missing positions are
    filled with zero, so a repeated day changes nothing and a skipped day
    shifts nothing.  Join on all keys; one output row per key.
    """
    day = F.lit(at).cast("date")
    month = F.trunc(day, "MM")
    t = daily.filter(F.col("date") == day).select(*keys, *[F.col(name).alias(f"_t_{name}") for name in measures])
    y = prev.filter(F.col("month_start") == month).select(*keys, *[F.col(a).alias(f"_y_{a}") for a in measures.values()])
    zero = F.lit(0).cast("bigint")
    arrays = [
        set_position(
            F.col(f"_y_{array}"), F.dayofmonth(day), F.coalesce(F.col(f"_t_{name}").cast("bigint"), zero), zero
        ).alias(array)
        for name, array in measures.items()
    ]
    return full_join(t, y, keys, bucketed).select(*keys, month.alias("month_start"), *arrays)


def monthly_array_backfill(
    events: DataFrame, keys: Sequence[str], day: Column, at, measures: Mapping[str, tuple[Column, str]]
) -> DataFrame:
    """The month's rows after day ``at``, from all of the month's events.

    ``measures`` maps a name to its aggregate and its array column.  Events are
    reduced to one row per key and day first, so at most 31 rows per key are
    collected.
    """
    until = F.lit(at).cast("date")
    month = F.trunc(until, "MM")
    per_day = (
        events.withColumn("_day", day)
        .filter(F.col("_day").between(month, until))
        .groupBy(*keys, "_day")
        .agg(*[m.cast("bigint").alias(name) for name, (m, _) in measures.items()])
        .withColumn("_dom", F.dayofmonth("_day"))
    )
    zero = F.lit(0).cast("bigint")
    collected = per_day.groupBy(*keys).agg(
        *[F.map_from_entries(F.collect_list(F.struct("_dom", name))).alias(name) for name in measures]
    )
    days = F.sequence(F.lit(1), F.dayofmonth(until))

    def positions(name: str) -> Column:
        return F.transform(days, lambda d: F.coalesce(F.try_element_at(F.col(name), d), zero))

    arrays = [positions(name).alias(array) for name, (_, array) in measures.items()]
    return collected.select(*keys, month.alias("month_start"), *arrays)


def monthly_array_rollup(
    arrays: DataFrame, groups: Sequence[str], array: str, month: str = "month_start"
) -> DataFrame:
    """Element-wise sum over entities, one row per group and date, any array length."""
    elements = arrays.select(*groups, month, F.posexplode(array).alias("_pos", "_value"))
    return (
        elements.groupBy(*groups, month, "_pos")
        .agg(F.sum("_value").alias("value"))
        .select(*groups, F.date_add(F.col(month), F.col("_pos")).alias("date"), "value")
    )
