"""Slowly changing dimension type 2: backfill and incremental step."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.joins import full_join


def scd2_backfill(
    snapshots: DataFrame,
    keys: Sequence[str],
    period: str,
    attrs: Sequence[str],
    upto: int,
    start: str = "start_period",
    end: str = "end_period",
    current: str = "current_period",
) -> DataFrame:
    """One row per run of equal attributes, from snapshots up to ``upto``.

    NULLs compare as equal, and a key's first row never counts as a change.
    ``snapshots`` has one row per key and period, so a key's window is bounded
    by the number of periods, and both steps share one partitioning by key.
    """
    by_period = Window.partitionBy(*keys).orderBy(period)
    state = F.struct(*attrs)
    flagged = (
        snapshots.filter(F.col(period) <= upto)
        .select(*keys, period, *attrs)
        .withColumn("_before", F.lag(state).over(by_period))
        .withColumn("_change", (F.col("_before").isNotNull() & ~state.eqNullSafe(F.col("_before"))).cast("int"))
    )
    running = by_period.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        flagged.withColumn("_run", F.sum("_change").over(running))
        .groupBy(*keys, "_run", *attrs)
        .agg(F.min(period).alias(start), F.max(period).alias(end))
        .select(*keys, *attrs, start, end, F.lit(upto).alias(current))
    )


def scd2_step(
    scd: DataFrame,
    today: DataFrame,
    keys: Sequence[str],
    period: str,
    attrs: Sequence[str],
    at: int,
    start: str = "start_period",
    end: str = "end_period",
    current: str = "current_period",
    bucketed: bool = False,
) -> DataFrame:
    """SCD snapshot of period ``at`` from the one before and the new period.

    Rows open at ``at - 1`` meet today's rows in one full outer join; each pair
    gives its one or two rows as an array of structs.  A key absent today keeps
    its open row, which closes at its old end.
    """
    before = at - 1
    snapshot = scd.filter(F.col(current) == before).drop(current)
    closed = snapshot.filter(F.col(end) < before)
    was = snapshot.filter(F.col(end) == before).select(
        *keys,
        F.struct(*attrs).alias("_was"),
        F.col(start).alias("_start"),
        F.col(end).alias("_end"),
    )
    now = today.filter(F.col(period) == at).select(*keys, F.struct(*attrs).alias("_now"))

    def version(state: str, first, last):
        return F.struct(*[F.col(state)[a].alias(a) for a in attrs], first.alias(start), last.alias(end))

    point = F.lit(at)
    kept = version("_was", F.col("_start"), F.col("_end"))
    extended = version("_was", F.col("_start"), point)
    opened = version("_now", point, point)
    versions = (
        F.when(F.col("_now").isNull(), F.array(kept))
        .when(F.col("_was").isNull(), F.array(opened))
        .when(F.col("_now").eqNullSafe(F.col("_was")), F.array(extended))
        .otherwise(F.array(kept, opened))
    )
    moved = full_join(was, now, keys, bucketed).select(*keys, versions.alias("_v")).select(*keys, F.inline("_v"))
    return closed.select(moved.columns).unionByName(moved).withColumn(current, point)
