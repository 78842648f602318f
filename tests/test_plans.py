"""What the physical plans must and must not contain."""

import re

from pyspark.sql import functions as F

import pytest

import __spark_entry__  # noqa: F401 - importing registers the queries
from tallyglass.operators.dedup import device_event_join
from tallyglass.operators.monthly import daily_measures
from tallyglass.operators.sessions import sessionize_batch
from tallyglass.plans import warehouse as wh
from tallyglass.plans.registry import QUERIES
from tallyglass.sources.schemas import schema
from tallyglass.sources.tables import overwrite_partition

# These write tables or run a stream while they are built.
EAGER = {
    "append_by_name", "bucketed_fact_join", "bucketed_match_lookup", "bucketed_player_join", "csv_scan", "layout_sizes",
    "layout_skipping", "overwrite_partition", "overwrite_table", "sessionize_stream", "traffic_account", "traffic_balance",
    "traffic_sessions", "traffic_sessions_late", "upsert", "upsert_many_partitions",
}
# One-row results: their last step is a single task over partial aggregates.
ONE_ROW = {
    "active_users", "cardinality_check", "cardinality_check_approx", "churn", "profile_date_range", "rolling_wins_max",
    "session_avg", "session_hits_check",
}
# One-row subqueries of partial aggregates, or a sum from day to day over one row per day of the calendar.
ONE_ROW_INSIDE = {
    "active_users_by_day", "active_users_series", "completeness_check", "debut_grid", "interval_join", "record_drift",
    "record_drift_changed",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join_no_python_no_single_task(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert not re.search(r"Cartesian|NestedLoop|EvalPython|InPandas|InArrow|MapPartitions|BatchScan", plan)
    if name in ONE_ROW:
        assert re.search(r"(Hash|Sort)Aggregate\([^\n]*\n[^\n]*Exchange SinglePartition", plan)
    elif name in ONE_ROW_INSIDE:
        # what comes together in one task has been aggregated before
        below = [plan.splitlines()[i + 1] for i, text in enumerate(plan.splitlines()) if "SinglePartition" in text]
        assert below and all("Aggregate(" in text for text in below)
    else:
        assert "SinglePartition" not in plan


def test_scans_read_only_the_columns_used(spark, sf_dir):
    plan = plan_of(QUERIES["datelist_int_from_events"](spark, sf_dir))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan) == ["ts:timestamp_ntz,user_id:bigint"]
    plan = plan_of(sessionize_batch(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], "ts", 300))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan and "IsNotNull(ts)" in plan


def test_a_day_is_pushed_to_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    daily = daily_measures(events, ["event_type"], F.to_date("ts"), "2024-01-05", {"n": F.count(F.lit(1))})
    pushed = re.search(r"PushedFilters: \[([^\n]*)\], ReadSchema", plan_of(daily)).group(1)
    assert "GreaterThanOrEqual(ts,2024-01-05" in pushed and "LessThan(ts,2024-01-06" in pushed


def test_a_step_reads_one_partition_of_its_state(spark, tmp_path):
    path = str(tmp_path / "players")
    seasons = spark.createDataFrame(
        [("a", *[None] * 6, s, 1, 1.0, 1.0, 1.0) for s in (2000, 2001)], schema("player_seasons")
    )
    overwrite_partition(wh.players_backfill(seasons, 2000, 2001), path, ["current_season"])
    step = wh.players_step(spark.read.schema(schema("players")).parquet(path), seasons, 2002)
    plan = plan_of(step)
    assert re.search(r"PartitionFilters: \[isnotnull\(current_season#\d+\), \(current_season#\d+ = 2001\)\]", plan)
    assert step.collect()[0].years_since_last_active == 1


def test_backfill_shuffles_its_facts_once_per_grain(spark, sf_dir):
    # One exchange to build a row per customer and year, one to gather a customer's years.
    for name in ("cumulative_backfill", "scd2_backfill"):
        assert plan_of(QUERIES[name](spark, sf_dir)).count("Exchange hashpartitioning") == 2


def test_bucketed_joins_have_no_exchange(spark, sf_dir):
    for name in ("bucketed_fact_join", "bucketed_player_join"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan


def test_session_hits_are_combined_before_the_shuffle(spark, sf_dir):
    plan = plan_of(sessionize_batch(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"], "ts", 300))
    below = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "partial_count" in below


def test_a_hot_device_is_split_over_tasks(spark):
    """A third of the events on one device, joins by shuffle: adaptive execution splits that partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        devices = spark.range(300).selectExpr("id AS device_id", "concat('b', id % 5) AS browser_type", "'os' AS os_type")
        events = spark.range(0, 120_000, 1, 8).selectExpr(
            "id AS user_id", "if(id % 3 = 0, 7L, id % 300) AS device_id", "'h' AS host", "timestamp_seconds(id) AS event_time"
        )
        per_browser = device_event_join(devices, events).groupBy("device_id", "browser_type").agg(
            F.count(F.lit(1)).alias("count"), F.sum(F.xxhash64("user_id") % 1000).alias("mixed")
        )
        counts = {r.device_id: r["count"] for r in per_browser.collect()}
        plan = plan_of(per_browser)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sum(counts.values()) == 120_000 and counts[7] > 40_000
    assert "SortMergeJoin(skew=true)" in plan


@pytest.mark.parametrize("name", ["cube_top_player_team", "cube_top_player_season", "cube_top_team"])
def test_one_grouping_is_aggregated_alone(spark, sf_dir, name):
    # the only Expand allowed is the one of a distinct count, which has no grouping id
    assert "spark_grouping_id" not in plan_of(QUERIES[name](spark, sf_dir))
