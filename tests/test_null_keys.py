"""NULL keys match each other in every step, and a bucketed snapshot is still read in place."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyglass.functions.columns import grade
from tallyglass.functions.joins import full_join
from tallyglass.operators.cumulative import cumulative_step, cumulative_step_multi
from tallyglass.operators.datelist import activity_datelist_step, host_datelist_step
from tallyglass.operators.monthly import monthly_array_step
from tallyglass.operators.scd import scd2_step
from tallyglass.operators.states import state_track_step
from tallyglass.sources.tables import write_bucketed
from tests.conftest import rows_of

DAY = date(2024, 1, 2)
BOUNDS = [(20, "star")]


def class_of(score):
    return grade(score, BOUNDS, "bad")


# Per step: snapshot schema and rows, new rows, and the call.
STEPS = {
    "cumulative_step": (
        "k string, history array<struct<y:int,v:int>>, grade string, periods_since_active int, is_active boolean, y int",
        [(k, [(2000, 1)], "bad", 0, True, 2000) for k in ("a", "b", None)],
        "k string, y int, v int", [("a", 2001, 30), (None, 2001, 30), ("c", 2001, 1)],
        lambda p, t, b: cumulative_step(p, t, ["k"], "y", ["v"], grade(F.col("v"), BOUNDS, "bad"), bucketed=b),
    ),
    "cumulative_step_multi": (
        "k string, grade string, is_active boolean, y int", [(k, "bad", True, 2000) for k in ("a", "b", None)],
        "k string, y int, v int", [("a", 2001, 30), (None, 2001, 30), (None, 2001, 40), ("c", 2001, 1)],
        lambda p, t, b: cumulative_step_multi(p, t, ["k"], "y", 2001, F.col("v"), class_of, bucketed=b),
    ),
    "state_track_step": (
        "k string, y int, player_status string", [(k, 2000, "New") for k in ("a", "b", None)],
        "k string, y int", [("a", 2001), (None, 2001), ("c", 2001)],
        lambda p, t, b: state_track_step(p, t, ["k"], "y", bucketed=b),
    ),
    "scd2_step": (
        "k string, g string, start_period int, end_period int, current_period int", [(k, "x", 1999, 2000, 2000) for k in ("a", "b", None)],
        "k string, g string, y int", [("a", "x", 2001), (None, "x", 2001), ("c", "x", 2001)],
        lambda p, t, b: scd2_step(p, t, ["k"], "y", ["g"], 2001, bucketed=b),
    ),
    "activity_datelist_step": (
        "k string, date date, device_activity_datelist array<date>", [(k, date(2024, 1, 1), [date(2024, 1, 1)]) for k in ("a", "b", None)],
        "k string, active_date date", [("a", DAY), (None, DAY), (None, DAY), ("c", DAY)],
        lambda p, t, b: activity_datelist_step(p, t, ["k"], DAY, bucketed=b),
    ),
    "host_datelist_step": (
        "k string, date date, host_activity_datelist array<date>", [(k, date(2024, 1, 1), [date(2024, 1, 1)]) for k in ("a", "b", None)],
        "k string, active_date date", [("a", DAY), (None, DAY), ("c", DAY)],
        lambda p, t, b: host_datelist_step(p, t, ["k"], DAY, bucketed=b),
    ),
    "monthly_array_step": (
        "k string, month_start date, hits array<bigint>", [(k, date(2024, 1, 1), [5]) for k in ("a", "b", None)],
        "k string, date date, n bigint", [("a", DAY, 7), (None, DAY, 7), ("c", DAY, 7)],
        lambda p, t, b: monthly_array_step(p, t, ["k"], DAY, {"n": "hits"}, bucketed=b),
    ),
}


@pytest.mark.parametrize("bucketed", [False, True])
@pytest.mark.parametrize("name", STEPS)
def test_null_key_on_both_sides_is_one_entity(spark, name, bucketed):
    prev_schema, prev, today_schema, today, step = STEPS[name]
    out = step(spark.createDataFrame(prev, prev_schema), spark.createDataFrame(today, today_schema), bucketed)
    rows = out.collect()
    assert sorted(str(r["k"]) for r in rows) == ["None", "a", "b", "c"]
    by_key = {r["k"]: tuple(r[c] for c in out.columns if c != "k") for r in rows}
    if name != "cumulative_step_multi":
        assert by_key[None] == by_key["a"]  # as any other key that was there and is there
    assert by_key[None] != by_key["b"]


@pytest.mark.parametrize("name", STEPS)
def test_bucketed_snapshot_is_read_in_place(spark, name):
    prev_schema, prev, today_schema, today, step = STEPS[name]
    stored = write_bucketed(spark, spark.createDataFrame(prev, prev_schema), "snapshot", 4, ["k"])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = step(stored, spark.createDataFrame(today, today_schema), True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    whole = [line for line in plan.splitlines() if "Exchange hashpartitioning(k#" in line]
    assert "Bucketed: true" in plan
    assert len(whole) <= 3  # all of today's rows: made distinct or averaged (for NULL keys apart), and dealt like the buckets


@pytest.mark.parametrize("bucketed", [False, True])
def test_full_join_on_two_keys(spark, bucketed):
    left = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (None, None, "c")], "x int, y int, l string")
    right = spark.createDataFrame([(1, None, "A"), (2, 2, "D"), (None, None, "C"), (None, 1, "E")], "x int, y int, r string")
    assert rows_of(full_join(left, right, ["x", "y"], bucketed)) == sorted(
        [(1, None, "a", "A"), (1, 2, "b", None), (None, None, "c", "C"), (2, 2, None, "D"), (None, 1, None, "E")],
        key=lambda r: [(v is not None, str(v)) for v in r],
    )


def test_large_counts_stay_exact(spark):
    big = 2**24 + 1
    state = spark.createDataFrame([], "k string, month_start date, hits array<bigint>")
    for d in range(1, 11):
        today = spark.createDataFrame([("a", date(2024, 1, d), big + d)], "k string, date date, n bigint")
        state = monthly_array_step(state, today, ["k"], date(2024, 1, d), {"n": "hits"})
    assert state.collect()[0]["hits"] == [big + d for d in range(1, 11)]
