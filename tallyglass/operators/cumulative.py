"""Cumulative dimension tables: one row per entity and period, history in an array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.columns import guarded_ratio, last_element
from tallyglass.functions.joins import full_join


def _entry(period: str, stats: Sequence[str]) -> Column:
    return F.struct(F.col(period), *[F.col(c) for c in stats])


def cumulative_step(
    prev: DataFrame,
    today: DataFrame,
    keys: Sequence[str],
    period: str,
    stats: Sequence[str],
    grade: Column,
    static: Sequence[str] = (),
    history: str = "history",
    bucketed: bool = False,
) -> DataFrame:
    """Next snapshot from the previous one and the new period's rows.

    ``prev`` and ``today`` hold at most one row per key.  ``grade`` is the
    class expression over ``today``; absent entities carry theirs.
    ``bucketed`` says that ``prev`` is stored bucketed by the keys.
    """
    t = today.select(
        *keys,
        *[F.col(c).alias(f"_t_{c}") for c in static],
        F.array(_entry(period, stats)).alias("_added"),
        F.col(period).alias("_now"),
        grade.alias("_grade"),
    )
    y = prev.select(
        *keys,
        *[F.col(c).alias(f"_y_{c}") for c in static],
        F.col(history).alias("_kept"),
        F.col("grade").alias("_old_grade"),
        F.col("periods_since_active").alias("_since"),
        F.col(period).alias("_before"),
    )
    here = F.col("_now").isNotNull()
    return full_join(t, y, keys, bucketed).select(
        *keys,
        *[F.coalesce(f"_t_{c}", f"_y_{c}").alias(c) for c in static],
        F.when(F.col("_kept").isNull(), F.col("_added"))
        .when(here, F.concat("_kept", "_added"))
        .otherwise(F.col("_kept"))
        .alias(history),
        F.when(here, F.col("_grade")).otherwise(F.col("_old_grade")).alias("grade"),
        F.when(here, F.lit(0)).otherwise(F.col("_since") + 1).alias("periods_since_active"),
        here.alias("is_active"),
        F.coalesce(F.col("_now"), F.col("_before") + 1).alias(period),
    )


def cumulative_backfill(
    facts: DataFrame,
    keys: Sequence[str],
    period: str,
    first: int,
    last: int,
    stats: Sequence[str],
    grade: Column,
    static: Sequence[str] = (),
    static_rule: str = "latest",
    history: str = "history",
) -> DataFrame:
    """All snapshots ``first..last`` at once, dense from each entity's debut.

    ``facts`` holds one row per key and period; a repeated one fails the job
    before anything is collected, so the array collected per key is bounded by
    the number of periods.  Rows are shuffled by key, where each entry covers
    the periods up to the next one and its history is a prefix of the sorted
    entries.  ``static_rule`` is
    ``latest`` (last non-NULL value so far, as the step gives) or ``max``.
    """
    if static_rule not in ("latest", "max"):
        raise ValueError(f"static_rule must be latest or max, not {static_rule}")
    entry = F.struct(
        F.col(period).alias("at"),
        _entry(period, stats).alias("stat"),
        grade.alias("grade"),
        F.struct(F.lit(True).alias("_"), *[F.col(c) for c in static]).alias("fixed"),
    )
    # Dealt by key once, for both aggregates; a key repeated without end is refused without being gathered.
    per_period = facts.filter(F.col(period).between(first, last)).repartition(*[F.col(k) for k in keys]).groupBy(*keys, F.col(period).alias("_at")).agg(
        F.min(entry).alias("_one"), F.count(F.lit(1)).alias("_n")
    )
    one = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"more than one row per key and {period}")).cast("boolean"))
    per_key = (
        per_period.withColumn("_one", F.when(one.isNull(), F.col("_one")))
        .groupBy(*keys)
        .agg(
            F.array_sort(F.collect_list("_one")).alias("_entries"),
            *[F.max(f"_one.fixed.{c}").alias(f"_max_{c}") for c in static if static_rule == "max"],
        )
    )
    placed = per_key.select(
        *keys,
        *[F.col(f"_max_{c}") for c in static if static_rule == "max"],
        "_entries",
        F.posexplode("_entries").alias("_pos", "_entry"),
    )
    at = F.col("_entry.at")
    following = F.get("_entries", F.col("_pos") + 1)["at"]
    until = F.coalesce(following - 1, F.lit(last))
    so_far = F.col("_pos") + 1

    def latest(column: str) -> Column:
        values = F.slice(F.col("_entries")["fixed"][column], F.lit(1), so_far)
        return F.coalesce(F.col("_entry.fixed")[column], last_element(F.array_compact(values)))

    fixed = [
        (F.col(f"_max_{c}") if static_rule == "max" else latest(c)).alias(c) for c in static
    ]
    spans = placed.select(
        *keys,
        *fixed,
        F.slice(F.col("_entries")["stat"], F.lit(1), so_far).alias(history),
        F.col("_entry.grade").alias("grade"),
        at.alias("_at"),
        F.explode(F.sequence(at, until)).alias(period),
    )
    return spans.select(
        *keys,
        *static,
        history,
        "grade",
        (F.col(period) - F.col("_at")).alias("periods_since_active"),
        (F.col(period) == F.col("_at")).alias("is_active"),
        period,
    )


def _period_scores(rows: DataFrame, keys: Sequence[str], period: str, average: Column, label: Sequence[str]) -> DataFrame:
    """Per key and period the average and the largest label values; combined on the map side, however many rows a key has."""
    scored = rows.select(*keys, F.col(period).alias("_at"), *label, average.cast("double").alias("_score"))
    return scored.groupBy(*keys, "_at").agg(F.avg("_score").alias("_score"), *[F.max(c).alias(c) for c in label])


def cumulative_step_multi(
    prev: DataFrame,
    today_rows: DataFrame,
    keys: Sequence[str],
    period: str,
    at: int,
    average: Column,
    grade,
    label: Sequence[str] = (),
    bucketed: bool = False,
) -> DataFrame:
    """Next state when an entity has several rows per period: one row per entity.

    ``grade`` is called with the period's average of ``average``; an absent
    entity keeps its class.  ``label`` columns take the period's largest value,
    or stay when it has none.  The rows themselves go to
    :func:`items_by_period`, so a state row never grows.
    """
    t = _period_scores(today_rows.filter(F.col(period) == at), keys, period, average, label).withColumnsRenamed(
        {c: f"_t_{c}" for c in label}
    )
    y = prev.select(*keys, *[F.col(c).alias(f"_y_{c}") for c in label], F.col("grade").alias("_old_grade"))
    here = F.col("_at").isNotNull()
    return full_join(t, y, keys, bucketed).select(
        *keys,
        *[F.coalesce(f"_t_{c}", f"_y_{c}").alias(c) for c in label],
        F.when(here, grade(F.col("_score"))).otherwise(F.col("_old_grade")).alias("grade"),
        here.alias("is_active"),
        F.lit(at).alias(period),
    )


def cumulative_bootstrap_multi(
    rows: DataFrame,
    keys: Sequence[str],
    period: str,
    at: int,
    average: Column,
    grade,
    label: Sequence[str] = (),
) -> DataFrame:
    """The state for period ``at`` that folding the step from the start gives."""
    per_period = _period_scores(rows.filter(F.col(period) <= at), keys, period, average, label)
    state = per_period.groupBy(*keys).agg(
        F.max("_at").alias("_last"),
        F.max_by("_score", "_at").alias("_score"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in label],
    )
    return state.select(
        *keys, *label, grade(F.col("_score")).alias("grade"), (F.col("_last") == at).alias("is_active"), F.lit(at).alias(period)
    )


def items_by_period(
    rows: DataFrame,
    keys: Sequence[str],
    period: str,
    item: Sequence[str],
    item_id: Sequence[str],
    parts: int = 1,
    items: str = "items",
) -> DataFrame:
    """Arrays of ``item`` structs per entity and period, in ``parts`` arrays by a hash of the item's id.

    A period's rows are written once and never change.  ``parts`` is the
    caller's choice, and the same for every entity and any amount of data: the
    most a row holds is an entity's rows of one period over ``parts``.
    """
    part = F.pmod(F.xxhash64(*item_id), F.lit(parts).cast("bigint")).cast("int")
    placed = rows.select(*keys, period, part.alias("part"), F.struct(*item).alias("_item"))
    return placed.groupBy(*keys, period, "part").agg(F.array_sort(F.collect_list("_item")).alias(items))


def with_items(state: DataFrame, stored: DataFrame, keys: Sequence[str], period: str, at: int, items: str = "items") -> DataFrame:
    """``state`` with each entity's items up to ``at`` in one array, by period and item.

    A view for entities whose items fit in a row; the stored arrays have no such limit.
    """
    until = stored.filter(F.col(period) <= at).select(*keys, F.col(period).alias("_at"), F.explode(items).alias("_item"))
    one = until.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_item"))).alias("_all"))
    joined = full_join(state, one.select(*keys, F.col("_all")["_item"].alias(items)), keys)
    return joined.filter(F.col(period).isNotNull())


def history_unnest(snapshot: DataFrame, keys: Sequence[str], history: str = "history") -> DataFrame:
    """One row per history element, its fields as columns."""
    return snapshot.select(*keys, F.inline(history))


def first_to_last_ratio(
    snapshot: DataFrame,
    keys: Sequence[str],
    field: str,
    period: str,
    at: int,
    grades: Sequence[str] | None = None,
    history: str = "history",
    sort: bool = True,
) -> DataFrame:
    """Last over first history value of ``field`` in one snapshot, largest first."""
    rows = snapshot.filter(F.col(period) == at)
    if grades is not None:
        rows = rows.filter(F.col("grade").isin(*grades))
    values = F.col(history)[field]
    ratio = guarded_ratio(last_element(values), F.try_element_at(values, F.lit(1)))
    out = rows.select(*keys, ratio.alias("ratio"))
    return out.orderBy(F.col("ratio").desc_nulls_last(), *keys) if sort else out
