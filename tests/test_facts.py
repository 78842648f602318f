from datetime import date, datetime, timedelta

from pyspark.sql import functions as F
from pyspark.testing import assertDataFrameEqual

import pytest

from tallyglass.operators.cube import cube_top, grouping_sets_cube
from tallyglass.operators.datelist import (
    activity_datelist_step,
    datelist_backfill,
    datelist_int,
    datelist_int_from_events,
    host_datelist_step,
)
from tallyglass.operators.dedup import dedup_keep_one, device_event_join
from tallyglass.operators.edges import build_edges
from tallyglass.operators.monthly import (
    daily_measures,
    monthly_array_backfill,
    monthly_array_rollup,
    monthly_array_step,
)
from tests.conftest import rows_of


def test_dedup_takes_the_first_by_order(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (1, "a", 2), (2, None, 5)], "k int, v string, n int")
    assert rows_of(dedup_keep_one(df, ["k"], ["v", "n"])) == rows_of(
        spark.createDataFrame([(1, "a", 2), (2, None, 5)], "k int, v string, n int")
    )
    with pytest.raises(ValueError):
        dedup_keep_one(df, ["k"], [])


def test_equal_events_become_one(spark):
    schema = "USER_ID bigint, DEVICE_ID bigint, HOST string, EVENT_TIME bigint"
    df = spark.createDataFrame([(1, 22, "site", 1234567890)] * 2, schema)
    out = dedup_keep_one(df, ["USER_ID", "DEVICE_ID", "HOST", "EVENT_TIME"], ["EVENT_TIME"])
    assertDataFrameEqual(out, spark.createDataFrame([(1, 22, "site", 1234567890)], schema))


def test_dedup_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS v")
    plan = dedup_keep_one(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_device_join_forms(spark):
    devices = spark.createDataFrame(
        [(1, "c", "w"), (1, "c", "w"), (1, "f", "w"), (2, "s", "m")], "device_id bigint, browser_type string, os_type string"
    )
    at = datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(7, 1, "h", at), (7, 1, "h", at), (None, 2, "h", at), (8, 3, "h", at)],
        "user_id bigint, device_id bigint, host string, event_time timestamp",
    )
    inner = device_event_join(devices, events)
    assert rows_of(inner, "device_id", "browser_type", "user_id") == [(1, "c", 7), (1, "f", 7)]
    left = device_event_join(devices, events, how="left")
    assert rows_of(left, "device_id", "browser_type", "user_id") == [(1, "c", 7), (1, "f", 7), (2, "s", None)]
    silent = device_event_join(devices, events.filter("device_id <> 2"), how="left")
    assert rows_of(silent, "device_id", "host") == [(1, "h"), (1, "h"), (2, None)]


LIST = "user_id bigint, device_id bigint, browser_type string, date date, device_activity_datelist array<date>"
KEYS = ["user_id", "device_id", "browser_type"]


def test_activity_list_cases(spark):
    d30, d31 = date(2023, 1, 30), date(2023, 1, 31)
    prev = spark.createDataFrame(
        [(1, 1, "c", d30, [d30]), (1, 2, None, d30, [d30]), (2, 1, "c", d30, [date(2023, 1, 2)])], LIST
    )
    today = spark.createDataFrame(
        [(1, 1, "c", d31), (1, 1, "c", d31), (1, 2, None, d31), (3, 9, "c", d31), (3, 9, "c", d30)],
        "user_id bigint, device_id bigint, browser_type string, active_date date",
    )
    out = activity_datelist_step(prev, today, KEYS, d31)
    got = {(r.user_id, r.device_id): r.device_activity_datelist for r in out.collect()}
    assert got == {(1, 1): [d31, d30], (1, 2): [d31, d30], (2, 1): [date(2023, 1, 2)], (3, 9): [d31]}
    assert {r.date for r in out.collect()} == {d31}


def test_host_list_is_oldest_first_without_nulls(spark):
    days = [date(2023, 1, 3), date(2023, 1, 4)]
    prev = spark.createDataFrame(
        [("a", days[0], [days[0]]), ("b", days[0], [days[0]])], "host string, date date, host_activity_datelist array<date>"
    )
    today = spark.createDataFrame([("a", days[1]), ("c", days[1])], "host string, active_date date")
    got = {r.host: r.host_activity_datelist for r in host_datelist_step(prev, today, ["host"], days[1]).collect()}
    assert got == {"a": days, "b": [days[0]], "c": [days[1]]}


def test_date_list_fold_equals_backfill(spark):
    events = spark.createDataFrame(
        [(u, date(2024, 1, 1) + timedelta(days=d)) for u, ds in {1: [0, 1, 4], 2: [2], 3: [0, 0, 3]}.items() for d in ds],
        "user bigint, day date",
    )
    state = spark.createDataFrame([], "user bigint, date date, dates array<date>")
    for d in range(5):
        at = date(2024, 1, 1) + timedelta(days=d)
        state = host_datelist_step(state, events.withColumnRenamed("day", "active_date"), ["user"], at, dates="dates")
    expected = datelist_backfill(events, ["user"], F.col("day"), date(2024, 1, 5), "dates", newest_first=False)
    assertDataFrameEqual(state, expected)


def test_activity_bits(spark):
    as_of = date(2024, 3, 1)
    ages = {"today": [0], "six": [6], "seven": [7], "thirty": [30], "last": [31], "too_old": [32], "mix": [0, 7, 31, 32]}
    events = spark.createDataFrame(
        [(k, as_of - timedelta(days=a)) for k, xs in ages.items() for a in xs] * 2, "k string, day date"
    )
    lists = datelist_backfill(events, ["k"], F.col("day"), as_of, "dates", newest_first=True)
    for top in (0, 1):
        from_lists = datelist_int(lists, ["k"], "dates", as_of, top)
        got = {r.k: r for r in from_lists.collect()}
        for k, xs in ages.items():
            field = sum(1 << (31 + top - a) for a in xs if top <= a <= 31 + top)
            r = got[k]
            assert r.datelist_int == field
            assert r.dim_is_monthly_active == (field != 0)
            assert r.dim_is_weekly_active == any(top <= a <= 6 + top for a in xs)
            assert r.dim_is_daily_active == (top in xs)
        assertDataFrameEqual(datelist_int_from_events(events, ["k"], F.col("day"), as_of, top), from_lists)


ARRAYS = "host string, month_start date, hits array<bigint>"


def month_step(prev, events, day):
    daily = daily_measures(events, ["host"], F.col("day"), day, {"n": F.count(F.lit(1))})
    return monthly_array_step(prev, daily, ["host"], day, {"n": "hits"})


def test_monthly_arrays_by_position(spark):
    days = {"a": [1, 2, 2, 5], "b": [3], "c": [5, 5]}
    events = spark.createDataFrame([(h, date(2023, 1, d)) for h, ds in days.items() for d in ds], "host string, day date")
    state = spark.createDataFrame([], ARRAYS)
    for d in (1, 2, 3, 5):  # day 4 is skipped
        state = month_step(state, events, date(2023, 1, d))
    expected = {"a": [1, 2, 0, 0, 1], "b": [0, 0, 1, 0, 0], "c": [0, 0, 0, 0, 2]}
    assert {r.host: r.hits for r in state.collect()} == expected
    # The same day again changes nothing; an earlier day again keeps the later ones.
    assert {r.host: r.hits for r in month_step(state, events, date(2023, 1, 5)).collect()} == expected
    assert {r.host: r.hits for r in month_step(state, events, date(2023, 1, 2)).collect()} == expected
    # The next month starts anew.
    assert month_step(state, events, date(2023, 2, 1)).count() == 0
    backfill = monthly_array_backfill(events, ["host"], F.col("day"), date(2023, 1, 5), {"n": (F.count(F.lit(1)), "hits")})
    assert {r.host: r.hits for r in backfill.collect()} == expected
    rolled = monthly_array_rollup(state.withColumn("m", F.lit("x")), ["m"], "hits")
    assert [(r.date.day, r.value) for r in rolled.orderBy("date").collect()] == [(1, 1), (2, 2), (3, 1), (4, 0), (5, 3)]


def test_cube_tells_a_null_from_a_subtotal(spark):
    df = spark.createDataFrame(
        [("p", "t", 2000, 10), ("p", None, 2001, 5), (None, "t", 2000, 3), ("p", "t", 2000, None)],
        "player string, team string, season int, pts int",
    )
    labels = {"player": "All Players", "team": "All Teams", "season": "All Seasons"}
    sets = [["player", "team"], ["player", "season"], ["team"]]
    cube = grouping_sets_cube(df.filter("pts IS NOT NULL"), sets, {"points": F.sum("pts")}, labels)
    assert rows_of(cube) == rows_of(
        spark.createDataFrame(
            [
                ("p", "t", "All Seasons", 10), ("p", None, "All Seasons", 5), (None, "t", "All Seasons", 3),
                ("p", "All Teams", "2000", 10), ("p", "All Teams", "2001", 5), (None, "All Teams", "2000", 3),
                ("All Players", "t", "All Seasons", 13), ("All Players", None, "All Seasons", 5),
            ],
            "player string, team string, season string, points bigint",
        )
    )
    assert cube_top(cube, labels, ["team"], "points").collect()[0].asDict() == {"team": "t", "points": 13}
    top = cube_top(cube, labels, ["player", "season"], "points").collect()[0]
    assert (top.player, top.season, top.points) == ("p", "2000", 10)


def test_edges_take_the_row_with_most_points(spark):
    rows = [(1, 101, "G", 25, 123, "BOS"), (2, 101, "F", 15, 456, "LAL"), (1, 102, "G", 30, 123, "BOS"), (1, 102, "F", 31, 123, "BOS")]
    df = spark.createDataFrame(
        rows, "player_id bigint, game_id bigint, start_position string, pts bigint, team_id bigint, team_abbreviation string"
    )
    props = ["start_position", "pts", "team_id", "team_abbreviation"]
    out = build_edges(df, "player_id", "game_id", "plays_in", props, [F.desc("pts"), "start_position"], "player", "game")
    expected = spark.createDataFrame(
        [
            (s, "player", o, "game", "plays_in", dict(zip(props, p)))
            for s, o, p in [
                (1, 101, ["G", "25", "123", "BOS"]), (2, 101, ["F", "15", "456", "LAL"]), (1, 102, ["F", "31", "123", "BOS"]),
            ]
        ],
        "subject_identifier bigint, subject_type string, object_identifier bigint, object_type string, edge_type string, "
        "properties map<string,string>",
    )
    assertDataFrameEqual(out, expected, ignoreNullable=True)
