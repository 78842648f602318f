"""The jobs against catalog tables."""

from datetime import date, datetime

import pytest

from tallyglass.plans.jobs import JOBS, PARTITIONS, create_state_tables, run_job
from tallyglass.session import fresh_path
from tallyglass.sources.schemas import schema
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def catalog(spark):
    """All tables in a database of their own."""
    spark.sql("DROP DATABASE IF EXISTS jobs_test CASCADE")
    spark.sql(f"CREATE DATABASE jobs_test LOCATION '{fresh_path(spark, 'db')}'")
    spark.sql("USE jobs_test")
    create_state_tables(spark, fresh_path(spark, "tables"))

    def source(name, rows):
        spark.createDataFrame(rows, schema(name)).write.saveAsTable(name)

    def season(name, year, pts):
        return (name, "6-6", "State", "USA", "1984", "1", "3", year, 80, float(pts), 5.0, 4.0)

    source("player_seasons", [season("a", 2000, 25), season("a", 2002, 5), season("b", 2001, 12)])
    source("actor_films", [("Ann", "a1", "One", 2000, 1, 8.5, "f1"), ("Ann", "a1", "Two", 2002, 1, 5.0, "f2")])
    source("devices", [(1, "Chrome", "Mac")])
    source("events", [(7, 1, "h", datetime(2023, 1, 1)), (7, 1, "h", datetime(2023, 1, 1)), (7, 1, "h", datetime(2023, 1, 3))])
    source("games", [(1, date(2020, 1, 1), 2019, 1, 2, 1)])
    source("game_details", [(1, 1, "AAA", 10, "Ann", "G", 8), (1, 1, "AAA", 10, "Ann", "G", 9), (1, 2, "BBB", 20, "Bob", "C", 3)])
    yield
    spark.sql("USE default")
    spark.sql("DROP DATABASE jobs_test CASCADE")


def test_season_jobs_can_be_repeated(spark, catalog):
    for season in (2000, 2001, 2002):
        for job in ("players", "player_state", "actors"):
            run_job(spark, job, season)
    before = {t: rows_of(spark.table(t)) for t in ("players", "player_state", "actors")}
    assert [len(before[t]) for t in before] == [5, 5, 3]
    for job in before:
        run_job(spark, job, 2001)
        assert rows_of(spark.table(job)) == before[job]
    assert rows_of(spark.table("player_state").filter("player_name = 'a'"), "current_season", "player_status") == [
        (2000, "New"), (2001, "Retired"), (2002, "Returned from Retirement"),
    ]

    for backfill, job in (("players_scd_backfill", "players_scd"), ("actor_history_scd_backfill", "actor_history_scd")):
        period = PARTITIONS[job][0]
        run_job(spark, backfill, 2001)
        stepped = rows_of(run_job(spark, job, 2002).filter(f"{period} = 2002"))
        assert stepped == rows_of(run_job(spark, backfill, 2002).filter(f"{period} = 2002")) and stepped


def test_day_jobs_can_be_repeated(spark, catalog):
    days = ["2023-01-01", "2023-01-02", "2023-01-03"]
    for day in [*days, days[-1]]:
        for job in ("user_devices_cumulated", "hosts_cumulated", "hosts_activity_reduced", "array_metrics"):
            run_job(spark, job, day)
    last = "date = DATE '2023-01-03'"
    dates = [date(2023, 1, 1), date(2023, 1, 3)]
    assert rows_of(spark.table("hosts_cumulated").filter(last), "host_activity_datelist") == [(dates,)]
    assert rows_of(spark.table("user_devices_cumulated").filter(last), "device_activity_datelist") == [(dates[::-1],)]
    assert rows_of(spark.table("hosts_activity_reduced"), "hit_array", "unique_visitors") == [([2, 0, 1], [1, 0, 1])]
    assert rows_of(spark.table("array_metrics"), "user_id", "metric_array") == [(7, [2, 0, 1])]
    assert spark.table("hosts_cumulated").count() == 3


def test_whole_table_jobs(spark, catalog):
    for _ in range(2):
        assert run_job(spark, "game_details_edge").count() == 2
        assert run_job(spark, "deduped_events").count() == 2
        cube = run_job(spark, "game_aggregates")
    team = cube.filter("player_name = 'All Players' AND team = 'AAA'").collect()[0]
    assert (team.total_points, team.total_wins, team.games_won) == (17, 2, 1)


def test_every_table_has_a_job():
    assert {target for target, _ in JOBS.values()} == set(PARTITIONS)
