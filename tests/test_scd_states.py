from pyspark.testing import assertDataFrameEqual

import pytest

from tallyglass.operators.scd import scd2_backfill, scd2_step
from tallyglass.operators.states import state_track_backfill, state_track_step
from tallyglass.plans.periods import empty_snapshot
from tests.conftest import rows_of

ATTRS = ["grade", "is_active"]
STATES = "key string, year int, grade string, is_active boolean"


@pytest.fixture(scope="module")
def snapshots(spark):
    """Dense states per key; the comment names the case."""
    rows = []
    for key, values in {
        "same": ["star", "star", "star"],
        "class": ["star", "good", "good"],
        "there_and_back": ["star", "good", "star"],
        "null_class": [None, None, "bad"],
        "to_null": ["bad", None, None],
    }.items():
        rows += [(key, 2000 + i, g, True) for i, g in enumerate(values)]
    rows += [("activity", 2000, "bad", True), ("activity", 2001, "bad", False), ("activity", 2002, "bad", False)]
    rows += [("both", 2000, "bad", True), ("both", 2001, "star", False), ("both", 2002, "star", False)]
    rows += [("new", 2002, "star", True)]
    return spark.createDataFrame(rows, STATES)


def backfill(df, upto):
    return scd2_backfill(df, ["key"], "year", ATTRS, upto)


def step(scd, df, at):
    return scd2_step(scd, df, ["key"], "year", ATTRS, at)


def test_backfill_runs(snapshots):
    got = rows_of(backfill(snapshots, 2002), "key", "grade", "is_active", "start_period", "end_period")
    assert got == rows_of(
        snapshots.sparkSession.createDataFrame(
            [
                ("same", "star", True, 2000, 2002),
                ("class", "star", True, 2000, 2000),
                ("class", "good", True, 2001, 2002),
                ("there_and_back", "star", True, 2000, 2000),
                ("there_and_back", "good", True, 2001, 2001),
                ("there_and_back", "star", True, 2002, 2002),
                ("null_class", None, True, 2000, 2001),
                ("null_class", "bad", True, 2002, 2002),
                ("to_null", "bad", True, 2000, 2000),
                ("to_null", None, True, 2001, 2002),
                ("activity", "bad", True, 2000, 2000),
                ("activity", "bad", False, 2001, 2002),
                ("both", "bad", True, 2000, 2000),
                ("both", "star", False, 2001, 2002),
                ("new", "star", True, 2002, 2002),
            ],
            "key string, grade string, is_active boolean, a int, b int",
        )
    )


def test_fold_of_steps_equals_backfill(spark, snapshots):
    scd = backfill(snapshots, 2000)
    for at in (2001, 2002):
        scd = step(scd, snapshots, at)
        assertDataFrameEqual(scd.select(sorted(scd.columns)), backfill(snapshots, at).select(sorted(scd.columns)))


def test_runs_do_not_overlap_and_cover(snapshots):
    years = snapshots.groupBy("key").count()
    runs = backfill(snapshots, 2002).selectExpr("key", "end_period - start_period + 1 AS n").groupBy("key").sum("n")
    assert rows_of(years) == rows_of(runs)


def test_step_keeps_a_key_that_is_absent_today(spark, snapshots):
    scd = backfill(snapshots, 2000)
    out = step(scd, snapshots.filter("key <> 'same'"), 2001)
    assert rows_of(out.filter("key = 'same'"), "start_period", "end_period", "current_period") == [(2000, 2000, 2001)]
    # Absent a second time, it stays in the closed history; back again, it opens a row.
    out = step(out, snapshots, 2002)
    assert rows_of(out.filter("key = 'same'"), "start_period", "end_period") == [(2000, 2000), (2002, 2002)]


def test_states_fold_equals_backfill_and_hits_all_states(spark):
    seen = {"stay": [0, 1, 2, 3, 4], "leave": [0, 1], "back": [0, 3, 4], "late": [2], "twice": [0, 2, 4]}
    facts = spark.createDataFrame(
        [(k, 2000 + y) for k, ys in seen.items() for y in ys], "name string, season int"
    )
    full = state_track_backfill(facts, ["name"], "season", 2000, 2004)
    state = empty_snapshot(spark, "name string, season int, player_status string")
    for season in range(2000, 2005):
        state = state_track_step(state, facts.filter(f"season = {season}"), ["name"], "season")
        assert rows_of(state, "name", "season", "player_status") == rows_of(
            full.filter(f"season = {season}"), "name", "season", "player_status"
        )
    assert {r.player_status for r in full.collect()} == {
        "New", "Continued Playing", "Retired", "Returned from Retirement", "Stayed Retired",
    }
