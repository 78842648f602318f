"""Activity date lists and their 32-bit form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.columns import DAY_MASK, FIELD_BITS, WEEK_MASK, active_bits, day_bit
from tallyglass.functions.joins import full_join


def _list_step(prev: DataFrame, today: DataFrame, keys, active: str, dates: str, at, newest_first: bool, bucketed: bool) -> DataFrame:
    day = F.lit(at).cast("date")
    t = today.filter(F.col(active) == day).select(*keys, F.col(active).alias("_added")).distinct()
    y = prev.filter(F.col("date") == F.date_sub(day, 1)).select(*keys, F.col(dates).alias("_kept"))
    added, kept = F.col("_added"), F.col("_kept")
    joined = F.array_prepend(kept, added) if newest_first else F.array_append(kept, added)
    return full_join(t, y, keys, bucketed).select(
        *keys,
        day.alias("date"),
        F.when(added.isNull(), kept).when(kept.isNull(), F.array(added)).otherwise(joined).alias(dates),
    )


def activity_datelist_step(
    prev: DataFrame, today: DataFrame, keys: Sequence[str], at, active: str = "active_date",
    dates: str = "device_activity_datelist", bucketed: bool = False,
) -> DataFrame:
    """Date-list snapshot of day ``at``, newest date first.

    ``prev`` is read at the day before and ``today`` at the day itself, so
    running a day again gives the same snapshot.  NULL keys match each other.
    """
    return _list_step(prev, today, keys, active, dates, at, newest_first=True, bucketed=bucketed)


def host_datelist_step(
    prev: DataFrame, today: DataFrame, keys: Sequence[str], at, active: str = "active_date",
    dates: str = "host_activity_datelist", bucketed: bool = False,
) -> DataFrame:
    """Date-list snapshot of day ``at``, oldest date first, without NULL elements."""
    return _list_step(prev, today, keys, active, dates, at, newest_first=False, bucketed=bucketed)


def datelist_backfill(
    events: DataFrame, keys: Sequence[str], day: Column, at, dates: str, newest_first: bool
) -> DataFrame:
    """Snapshot of day ``at`` from all events up to it.

    Days are made distinct per key before they are collected, so the array and
    the shuffled rows are bounded by the calendar, however many events a key has.
    """
    until = F.lit(at).cast("date")
    days = events.select(*keys, day.alias("_day")).filter(F.col("_day") <= until)
    listed = days.groupBy(*keys).agg(
        F.sort_array(F.collect_set("_day"), asc=not newest_first).alias(dates)
    )
    return listed.select(*keys, until.alias("date"), dates)


def datelist_int(
    snapshot: DataFrame, keys: Sequence[str], dates: str, as_of, top_bit_age: int = 0
) -> DataFrame:
    """32-bit activity field and monthly, weekly and daily flags per key.

    The field is computed inside the row from the list, without a join to a
    calendar.  ``top_bit_age=1`` puts yesterday into the top bit.
    """
    day = F.lit(as_of).cast("date")
    field = active_bits(F.col(dates), day, top_bit_age)
    rows = snapshot.filter(F.col("date") == day).select(*keys, field.alias("datelist_int"))
    return with_activity_flags(rows)


def datelist_int_from_events(
    events: DataFrame, keys: Sequence[str], day: Column, as_of, top_bit_age: int = 0
) -> DataFrame:
    """The same result straight from events: one bitwise-or aggregate per key.

    Nothing but one long per key and input partition is shuffled.
    """
    until = F.lit(as_of).cast("date")
    shift = F.lit(FIELD_BITS - 1 + top_bit_age) - F.datediff(until, F.col("_day"))
    bit = F.when((shift >= 0) & (shift < FIELD_BITS), day_bit(shift)).otherwise(F.lit(0).cast("bigint"))
    rows = (
        events.select(*keys, day.alias("_day"))
        .filter(F.col("_day") <= until)
        .groupBy(*keys)
        .agg(F.bit_or(bit).alias("datelist_int"))
    )
    return with_activity_flags(rows)


def with_activity_flags(rows: DataFrame, field: str = "datelist_int") -> DataFrame:
    """Add the monthly, weekly and daily flags of a 32-bit activity field."""
    bits = F.col(field)

    def any_of(mask: int) -> Column:
        return F.bit_count(bits.bitwiseAND(F.lit(mask).cast("bigint"))) > 0

    return rows.select(
        "*",
        (F.bit_count(bits) > 0).alias("dim_is_monthly_active"),
        any_of(WEEK_MASK).alias("dim_is_weekly_active"),
        any_of(DAY_MASK).alias("dim_is_daily_active"),
    )
