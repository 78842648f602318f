"""Presence state of an entity per period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.joins import full_join

# The states a row can have.
NEW = "New"
CONTINUED = "Continued Playing"
RETIRED = "Retired"
RETURNED = "Returned from Retirement"
STAYED_RETIRED = "Stayed Retired"
UNKNOWN = "Unknown"


def state_track_step(
    prev: DataFrame,
    today: DataFrame,
    keys: Sequence[str],
    period: str,
    static: Sequence[str] = (),
    status: str = "player_status",
    bucketed: bool = False,
) -> DataFrame:
    """State snapshot of the next period from the previous one and today's rows.

    Both sides hold at most one row per key.
    """
    t = today.select(*keys, *[F.col(c).alias(f"_t_{c}") for c in static], F.col(period).alias("_now"))
    y = prev.select(
        *keys,
        *[F.col(c).alias(f"_y_{c}") for c in static],
        F.col(period).alias("_before"),
        F.col(status).alias("_was"),
    )
    here, known = F.col("_now").isNotNull(), F.col("_before").isNotNull()
    away = F.col("_was").isin(RETIRED, STAYED_RETIRED)
    state = (
        F.when(~known & here, NEW)
        .when(away & here, RETURNED)
        .when(known & here, CONTINUED)
        .when(known & away, STAYED_RETIRED)
        .when(known, RETIRED)
        .otherwise(UNKNOWN)
    )
    return full_join(t, y, keys, bucketed).select(
        *keys,
        *[F.coalesce(f"_t_{c}", f"_y_{c}").alias(c) for c in static],
        F.coalesce(F.col("_now"), F.col("_before") + 1).alias(period),
        state.alias(status),
    )


def state_track_backfill(
    facts: DataFrame,
    keys: Sequence[str],
    period: str,
    first: int,
    last: int,
    status: str = "player_status",
) -> DataFrame:
    """States of all periods ``first..last`` from each entity's debut.

    A key's periods are collected as a set, bounded by the number of periods,
    and the state follows from the distance to the entry before, without a
    grid join or a window.
    """
    per_key = (
        facts.filter(F.col(period).between(first, last))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set(period)).alias("_seen"))
    )
    placed = per_key.select(*keys, "_seen", F.posexplode("_seen").alias("_pos", "_at"))
    before = F.get("_seen", F.col("_pos") - 1)
    until = F.coalesce(F.get("_seen", F.col("_pos") + 1) - 1, F.lit(last))
    spans = placed.select(
        *keys, "_at", before.alias("_before"), F.explode(F.sequence(F.col("_at"), until)).alias(period)
    )
    age = F.col(period) - F.col("_at")
    state = (
        F.when((age == 0) & F.col("_before").isNull(), NEW)
        .when((age == 0) & (F.col("_at") - F.col("_before") > 1), RETURNED)
        .when(age == 0, CONTINUED)
        .when(age == 1, RETIRED)
        .when(age > 1, STAYED_RETIRED)
        .otherwise(UNKNOWN)
    )
    return spans.select(*keys, period, state.alias(status))
