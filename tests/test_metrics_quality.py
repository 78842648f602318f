from datetime import date, datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

import pytest

from tallyglass.operators import metrics, quality
from tests.conftest import rows_of

DAY = F.to_date


@pytest.fixture(scope="module")
def events(spark):
    rows = []
    for user, days in {"a": [0, 3, 8], "b": [0], "c": [0, 20], "d": [25, 29]}.items():
        for d in days:
            rows += [(user, "view", datetime(2024, 1, 1) + timedelta(days=d, hours=23)), (user, "click" if user != "b" else "view", datetime(2024, 1, 1) + timedelta(days=d, hours=23, minutes=1))]
    return spark.createDataFrame(rows, "user string, kind string, ts timestamp_ntz")


def test_retention_and_churn(events):
    got = rows_of(metrics.retention(events, "user", DAY("ts"), [7, 30], "2024-01-30"))
    assert got == [(date(2024, 1, 1), 3, 1, None), (date(2024, 1, 26), 1, None, None)]
    later = metrics.retention(events, "user", DAY("ts"), [7, 30], "2024-03-01")
    assert rows_of(later) == [(date(2024, 1, 1), 3, 1, 2), (date(2024, 1, 26), 1, 1, 1)]
    assert rows_of(metrics.churn(events, "user", DAY("ts"), 7, "2024-01-30")) == [(3, 3)]


def test_active_users(events):
    assert rows_of(metrics.active_users(events, "user", DAY("ts"), "2024-01-30")) == [(1, 1, 4)]


def test_rates_and_actions(events):
    kind = F.col("kind")
    rate = metrics.rate_between(events, ["kind"], "user", kind == "click", kind == "view").collect()
    assert {(r.kind, r.base_users, r.reached_users, r.rate) for r in rate} == {("view", 4, 0, 0.0), ("click", 0, 3, None)}
    got = rows_of(metrics.actions_per_user(events, "user", "kind", ["view", "click"]))
    assert got == [("a", 3, 3), ("b", 2, 0), ("c", 2, 2), ("d", 2, 2)]


def test_sessions_per_week(events):
    got = metrics.sessions_per_week(events.filter("user = 'a'"), "user", "ts", 300)
    assert rows_of(got) == [("a", date(2024, 1, 1), 2, 120.0), ("a", date(2024, 1, 8), 1, 60.0)]


def test_completion_and_promoters(spark):
    df = spark.createDataFrame([("x", 90, 100), ("x", 89, 100), ("x", 5, 0)], "k string, done int, total int")
    assert rows_of(metrics.completion_rate(df, ["k"], F.col("done"), F.col("total"))) == [("x", 2, 1, 0.5)]
    scores = spark.createDataFrame([("k", s) for s in (10, 9, 8, 7, 6, 0, 11)], "k string, s int")
    assert rows_of(metrics.net_promoter_score(scores, ["k"], F.col("s"))) == [("k", 6, 2, 2, 0.0)]


def test_cells_are_stable_and_near_their_share(spark):
    users = spark.range(20_000).select(F.col("id").alias("user"))
    cells = {"A": 33, "B": 33, "C": 34}
    placed = metrics.experiment_cells(users, "user", "e1", cells)
    shares = {r.cell: r["count"] / 200 for r in placed.groupBy("cell").count().collect()}
    assert all(abs(shares[c] - cells[c]) < 1.5 for c in cells)
    again = metrics.experiment_cells(users, "user", "e1", cells)
    assert placed.exceptAll(again).count() == 0
    assert placed.join(metrics.experiment_cells(users, "user", "e2", cells), ["user", "cell"]).count() < 8000
    with pytest.raises(ValueError):
        metrics.experiment_cells(users, "user", "e1", {"A": 50})


def test_completeness_and_freshness(spark):
    rows = [("k", date(2024, 1, d)) for d in range(1, 6) for _ in range(10)] + [("k", date(2024, 1, 6))] * 4
    df = spark.createDataFrame(rows, "k string, day date")
    got = quality.completeness(df, ["k"], F.col("day"), trailing=3).filter("is_low").collect()
    assert [(r.day, r.row_count, r.trailing_mean) for r in got] == [(date(2024, 1, 6), 4, 10.0)]
    # days 6 and 7 missing: both are flagged, at 0 rows
    gone = spark.createDataFrame([("k", date(2024, 1, d)) for d in (1, 2, 3, 4, 5, 8) for _ in range(10)], "k string, day date")
    low = quality.completeness(gone, ["k"], F.col("day"), trailing=3).filter("is_low").collect()
    assert [(r.day, r.row_count) for r in low] == [(date(2024, 1, 6), 0), (date(2024, 1, 7), 0)]
    until = quality.completeness(gone, ["k"], F.col("day"), trailing=3, as_of="2024-01-10").filter("is_low").collect()
    assert sorted(r.day for r in until)[-1] == date(2024, 1, 10)
    fresh = quality.freshness(df, ["k"], "day", "2024-01-08").collect()[0]
    assert (fresh.age_days, fresh.is_stale) == (2, True)


def test_schema_drift(spark):
    expected = T.StructType.fromDDL("a int, b string, c double")
    found = T.StructType.fromDDL("a bigint, c double, d string")
    assert rows_of(quality.schema_drift(spark, found, expected), "column", "drift") == [("a", "type"), ("b", "missing"), ("d", "added")]
    assert quality.schema_drift(spark, expected, expected).count() == 0


def test_malformed_rows(spark):
    df = spark.createDataFrame([(1, '{"k": 3}'), (2, '{"k": "x"}'), (3, "oops"), (4, None), (5, '{"k": 30}'), (6, "{}")], "id int, props string")
    good, bad = quality.malformed_split(df, "props", "k int", {"range": F.col("record_value.k") < 10})
    assert rows_of(good, "id", "record_value.k") == [(1, 3)]
    assert rows_of(bad, "id", "reason") == [(2, "unparsed"), (3, "unparsed"), (4, "unparsed"), (5, "range"), (6, "range")]


def test_duplicates_fast_users_and_names(spark, events):
    dup = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    assert rows_of(quality.duplicate_keys(dup, ["id"])) == [(1, 2)]
    busy = spark.createDataFrame([("bot", datetime(2024, 1, 1, 0, 0, s)) for s in range(10)] + [("me", datetime(2024, 1, 1))], "u string, ts timestamp_ntz")
    assert rows_of(quality.fast_users(busy, "u", "ts", "minute", 5)) == [("bot", 10)]
    assert rows_of(quality.without_fast_users(busy, "u", "ts", "minute", 5), "u") == [("me",)]
    assert rows_of(quality.unknown_names(events, "kind", ["view"])) == [("click", 7)]
    known = spark.createDataFrame([("click",)], "kind string")
    assert rows_of(quality.unknown_names(events, "kind", known)) == [("view", 9)]
    assert rows_of(quality.cardinality(events, ["kind", "user"], 3, exact=True)) == [("kind", 2, False), ("user", 4, True)]


def test_day_by_zone(spark):
    df = spark.createDataFrame([(datetime(2024, 7, 1, 2),), (datetime(2024, 7, 1, 12),)], "ts timestamp_ntz")
    got = rows_of(quality.daily_by_zone(df, "ts", "America/New_York"))
    assert got == [
        ("America/New_York", date(2024, 6, 30), 1), ("America/New_York", date(2024, 7, 1), 1), ("UTC", date(2024, 7, 1), 2),
    ]


def test_layout_sizes(spark):
    df = spark.range(5000).selectExpr("id % 7 AS k", "id AS v")
    got = {r.layout: r for r in quality.layout_sizes(df, {"plain": ([], []), "sorted": (["k"], ["k", "v"])}, 4).collect()}
    assert got["plain"].row_count == got["sorted"].row_count == 5000 and got["plain"].files == 4
