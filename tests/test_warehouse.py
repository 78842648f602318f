"""The jobs on tables with the warehouse's own column names."""

from datetime import date, datetime

from pyspark.sql import functions as F

import pytest

from tallyglass.plans import warehouse as wh
from tallyglass.plans.periods import run_periods
from tallyglass.sources.schemas import KEYS, TABLES, schema
from tallyglass.sources.tables import assert_unique
from tests.conftest import rows_of


def table(spark, name, rows):
    return spark.createDataFrame(rows, schema(name))


@pytest.fixture(scope="module")
def player_seasons(spark):
    def season(name, year, pts):
        return (name, "6-6", "State", "USA", "1984", "1", "3", year, 80, float(pts), 5.0, 4.0)

    return table(
        spark, "player_seasons",
        [season("mj", 1996, 29.6), season("mj", 1997, 28.7), season("mj", 2000, 22.9), season("bench", 1998, 3.1), season("edge", 1999, 20.0)],
    )


def test_players_fold_scd_and_states(spark, player_seasons, tmp_path):
    years = range(1996, 2001)
    folded = run_periods(
        spark, str(tmp_path / "players"), schema("players"), "current_season", years,
        lambda prev, season: wh.players_step(prev, player_seasons, season),
    )
    columns = schema("players").names
    full = wh.players_backfill(player_seasons, 1996, 2000)
    assert full.schema.simpleString() == schema("players").simpleString()
    assert rows_of(folded, *columns) == rows_of(full, *columns)
    assert_unique(folded, KEYS["players"])

    mj = full.filter("player_name = 'mj' AND current_season = 1999").collect()[0]
    assert (mj.scoring_class, mj.years_since_last_active, mj.is_active, len(mj.season_stats)) == ("star", 2, False, 2)
    assert mj.draft_round == "1" and mj.draft_number == "3"
    assert full.filter("player_name = 'edge' AND scoring_class = 'good'").count() == 2
    assert wh.player_history(full, 2000).count() == 5
    first = wh.most_improved(full, 2000, ["star"]).collect()
    assert [r.player_name for r in first] == ["mj"] and abs(first[0].ratio - 22.9 / 29.6) < 1e-6

    scd = wh.players_scd_backfill(full, 1999)
    stepped = wh.players_scd_step(scd, full, 2000)
    names = schema("players_scd").names
    assert rows_of(stepped, *names) == rows_of(wh.players_scd_backfill(full, 2000), *names)
    assert_unique(stepped, KEYS["players_scd"])

    states = run_periods(
        spark, str(tmp_path / "state"), schema("player_state"), "current_season", years,
        lambda prev, season: wh.player_state_step(prev, player_seasons, season),
    )
    assert [r.player_status for r in states.filter("player_name = 'mj'").orderBy("current_season").collect()] == [
        "New", "Continued Playing", "Retired", "Stayed Retired", "Returned from Retirement",
    ]


def test_actors(spark):
    films = table(
        spark, "actor_films",
        [
            ("Ann", "a1", "One", 2018, 10, 8.5, "f1"), ("Ann", "a1", "Two", 2018, 10, 7.9, "f2"),
            ("Ann", "a1", "Three", 2020, 10, 5.0, "f3"), ("Bob", "b1", "Four", 2019, 10, 7.0, "f4"),
        ],
    )
    state = wh.empty_table(spark, "actors")
    snapshots = None
    for year in (2018, 2019, 2020):
        state = wh.actors_step(state, films, year)
        snapshots = state if snapshots is None else snapshots.unionByName(state)
    columns = schema("actors").names
    assert rows_of(state, *columns) == rows_of(wh.actors_bootstrap(films, 2020), *columns)
    assert rows_of(snapshots, "actorid", "film_year", "quality_class", "is_active") == [
        ("a1", 2018, "star", True), ("a1", 2019, "star", False), ("a1", 2020, "bad", True),
        ("b1", 2019, "average", True), ("b1", 2020, "average", False),
    ]
    scd = wh.actors_scd_backfill(snapshots, 2019)
    assert scd.schema.simpleString() == schema("actor_history_scd").simpleString()
    stepped = wh.actors_scd_step(scd, snapshots, 2020)
    names = schema("actor_history_scd").names
    assert rows_of(stepped, *names) == rows_of(wh.actors_scd_backfill(snapshots, 2020), *names)


@pytest.fixture(scope="module")
def web(spark):
    def at(day, hour=1):
        return datetime(2023, 1, day, hour)

    devices = table(spark, "devices", [(1, "Chrome", "Mac"), (1, "Chrome", "Mac"), (2, None, "Linux")])
    events = table(
        spark, "events",
        [(7, 1, "h1", at(1)), (7, 1, "h1", at(1)), (7, 1, "h2", at(2)), (8, 2, "h1", at(1)), (8, 2, "h1", at(3)), (None, 1, "h1", at(3))],
    )
    return devices, events


def test_web_tables(spark, web):
    devices, events = web
    users, hosts = wh.empty_table(spark, "user_devices_cumulated"), wh.empty_table(spark, "hosts_cumulated")
    reduced, metrics = wh.empty_table(spark, "hosts_activity_reduced"), wh.empty_table(spark, "array_metrics")
    for day in (1, 2, 3):
        users = wh.user_devices_step(users, devices, events, f"2023-01-0{day}")
        hosts = wh.hosts_step(hosts, events, f"2023-01-0{day}")
        reduced = wh.hosts_reduced_step(reduced, events, f"2023-01-0{day}")
        metrics = wh.array_metrics_step(metrics, events, f"2023-01-0{day}")
    for name, df in [
        ("user_devices_cumulated", users), ("hosts_cumulated", hosts), ("hosts_activity_reduced", reduced), ("array_metrics", metrics),
    ]:
        assert df.schema.simpleString() == schema(name).simpleString()
    lists = {(r.user_id, r.browser_type): r.device_activity_datelist for r in users.collect()}
    assert lists == {(7, "Chrome"): [date(2023, 1, 2), date(2023, 1, 1)], (8, None): [date(2023, 1, 3), date(2023, 1, 1)]}
    assert {r.host: r.host_activity_datelist for r in hosts.collect()} == {
        "h1": [date(2023, 1, 1), date(2023, 1, 3)], "h2": [date(2023, 1, 2)],
    }
    assert rows_of(reduced, "host", "hit_array", "unique_visitors") == [
        ("h1", [3.0, 0.0, 2.0], [2.0, 0.0, 1.0]), ("h2", [0.0, 1.0, 0.0], [0.0, 1.0, 0.0]),
    ]
    assert rows_of(metrics, "user_id", "metric_array") == [(7, [2.0, 1.0, 0.0]), (8, [1.0, 0.0, 1.0])]
    assert [r.value for r in wh.metric_by_day(metrics).orderBy("date").collect()] == [3.0, 1.0, 1.0]
    bits = {r.user_id: r for r in wh.user_device_bits(users, "2023-01-03").collect()}
    assert bits[7].datelist_int == 3 << 29 and not bits[7].dim_is_daily_active and bits[8].dim_is_daily_active
    by_user = users.select("user_id", "date", F.col("device_activity_datelist").alias("dates_active"))
    lagged = {r.user_id: r.datelist_int for r in wh.user_bits(by_user, "2023-01-03", top_bit_age=1).collect()}
    assert lagged == {7: 3 << 30, 8: 1 << 30}
    assert wh.unique_events(events).count() == 5


@pytest.fixture(scope="module")
def league(spark):
    games = table(
        spark, "games", [(g, date(2020, 1, g), 2019 + g // 4, 1, 2, int(g != 3)) for g in range(1, 7)]
    )
    details = []
    for g in range(1, 7):
        details += [(g, 1, "AAA", 10, "Ann", "G", 8 + g), (g, 1, "AAA", 11, "Abe", "F", 30), (g, 2, "BBB", 20, "Bob", "C", None if g == 5 else 12)]
    details.append(details[0])
    return table(spark, "game_details", details), games


def test_league(league):
    details, games = league
    assert wh.unique_game_details(details).count() == 18
    cube = wh.game_aggregates(wh.unique_game_details(details), games)
    assert wh.top_scorer_for_team(cube).collect()[0].asDict() == {"player_name": "Abe", "team": "AAA", "total_points": 180}
    top = wh.top_scorer_in_season(cube).collect()[0]
    assert (top.player_name, top.season, top.total_points) == ("Abe", "2019", 90)
    assert wh.most_winning_team(cube).collect()[0].asDict() == {"team": "AAA", "games_won": 5}
    team = cube.filter("player_name = 'All Players' AND team = 'AAA'").collect()[0]
    assert (team.total_wins, team.games_won) == (10, 5)
    assert wh.most_wins_in_stretch(details, games).collect()[0].most_wins_in_90_game_stretch == 5
    assert wh.most_wins_in_stretch(details, games, 3).collect()[0][0] == 3
    assert wh.scoring_streak(details, games, "Ann").collect()[0].max_consecutive_games_over_10_points == 4
    assert wh.scoring_streak(details, games, "Bob").collect()[0][1] == 4
    assert wh.scoring_streak(details, games, "Nobody").count() == 0
    edges = wh.game_edges(details)
    assert edges.count() == 18 and edges.filter("properties['pts'] = '30'").count() == 6


def test_matches(spark):
    def match(m, mapid, playlist):
        return (m, mapid, True, playlist, None, True, None, None, None, None)

    def detail(m, player, kills):
        row = dict.fromkeys(schema("match_details").names) | {
            "match_id": m, "player_gamertag": player, "player_total_kills": kills,
        }
        return tuple(row.values())

    matches = table(spark, "matches", [match("m1", "x", "p"), match("m2", "x", "p"), match("m3", "y", "q")])
    details = table(spark, "match_details", [detail("m1", "ann", 5), detail("m1", "bob", 9), detail("m2", "ann", 6), detail("m3", "bob", 1)])
    given = table(
        spark, "medals_matches_players",
        [("m1", "ann", 1, 2), ("m1", "bob", 2, 1), ("m3", "bob", 1, 7), ("m3", "bob", 2, 1)],
    )
    medals = table(spark, "medals", [(1, "Killing Spree"), (2, "Other")])
    maps = table(spark, "maps", [("x",), ("y",)])
    joined = wh.match_medals_joined(matches, details, given, medals, maps, n_buckets=4)
    assert rows_of(joined, "match_id", "player_gamertag", "medal_name", "count", "player_total_kills", "mapid") == [
        ("m1", "ann", "Killing Spree", 2, 5, "x"), ("m1", "bob", "Other", 1, 9, "x"),
        ("m3", "bob", "Killing Spree", 7, 1, "y"), ("m3", "bob", "Other", 1, 1, "y"),
    ]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("Bucketed: true") == 2
    assert wh.top_killer(details).collect()[0].asDict() == {"player_gamertag": "ann", "avg_kills_per_game": 5.5}
    assert wh.top_playlist(matches).collect()[0].asDict() == {"playlist_id": "p", "match_count": 2}
    assert wh.top_map(matches).collect()[0].asDict() == {"mapid": "x", "match_count": 2}
    assert wh.top_map_for_medal(matches, given, medals).collect()[0].asDict() == {"mapid": "y", "medal_count": 7}


def test_session_reports(spark):
    rows = [(datetime(2024, 1, 1), "1.1.1.1", "blog.example.io", 2)]
    sessions = table(spark, "sessionized_aggregated_events", rows)
    assert wh.average_session(sessions, ".example.io").collect()[0][0] == 2.0
    assert [tuple(r) for r in wh.compare_hosts(sessions, ["blog.example.io", "absent.io"]).collect()] == [("blog.example.io", 2.0, 1, 2)]


def test_all_schemas_parse():
    for name in TABLES:
        assert schema(name).fields
    assert len(schema("match_details")) == 36
