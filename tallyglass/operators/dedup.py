"""Keyed deduplication and the device/event join built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_keep_one(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """Keep the first row per key in ``order_by`` order.

    The order is required and should break every tie.  Spark limits each group
    to one row inside each input partition before the shuffle
    (``WindowGroupLimit``), so a group holding a third of the rows still
    reaches its task as one row per input partition.
    """
    if not order_by:
        raise ValueError("dedup_keep_one needs an order that picks the surviving row")
    ranked = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") == 1).drop("_rank")


def distinct_on(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of ``columns``; combined on the map side."""
    return df.select(*columns).distinct()


def device_event_join(
    devices: DataFrame,
    events: DataFrame,
    device_key: str = "device_id",
    device_attrs: Sequence[str] = ("browser_type", "os_type"),
    event_keys: Sequence[str] = ("user_id", "device_id", "host", "event_time"),
    how: str = "inner",
    user_key: str = "user_id",
) -> DataFrame:
    """Join deduplicated devices with deduplicated events on the device.

    Both deduplication keys cover every column kept, so ``distinct`` does it.
    ``how="inner"`` keeps device events of known users; ``how="left"`` keeps
    every device, with NULLs where it has no event.  The left form is the inner
    join plus the devices without events: an inner join lets Spark split a
    device that holds a large share of the events, a left join would not.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how}")
    unique_events = distinct_on(events, event_keys)
    if how == "inner":
        unique_events = unique_events.filter(F.col(user_key).isNotNull())
    unique_devices = distinct_on(devices, [device_key, *device_attrs])
    matched = unique_devices.join(unique_events, device_key)
    if how == "inner":
        return matched
    seen = unique_events.select(device_key).distinct()
    silent = unique_devices.join(seen, device_key, "left_anti")
    return matched.unionByName(silent, allowMissingColumns=True)


def device_days(
    devices: DataFrame,
    events: DataFrame,
    keys: Sequence[str] = ("user_id", "device_id", "browser_type"),
    device_key: str = "device_id",
    user_key: str = "user_id",
    ts: str = "event_time",
    name: str = "active_date",
) -> DataFrame:
    """Distinct (user, device, browser, day) of known users.

    The same rows as :func:`device_event_join` by day, but events become one
    row per user, device and day before they meet the devices.
    """
    of_event = [k for k in keys if k in events.columns]
    of_device = [device_key, *[k for k in keys if k not in of_event]]
    days = events.filter(F.col(user_key).isNotNull()).select(*of_event, F.to_date(ts).alias(name)).distinct()
    return distinct_on(devices, of_device).join(days, device_key).select(*keys, name)
