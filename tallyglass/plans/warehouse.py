"""The operators on the warehouse's own tables, with its column names.

Source and state tables have the schemas of ``sources.schemas``.  A step takes
the state table and the sources, and returns the next snapshot to be written
with ``overwrite_partition`` or driven by ``run_periods``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.columns import grade, one_of
from tallyglass.functions.joins import full_join
from tallyglass.functions.skew import broadcast_checked
from tallyglass.operators.bucketed import bucketed_fact_join, most_played, top_avg_per_game, top_filtered_sum
from tallyglass.operators.cube import cube_top, grouping_sets_cube
from tallyglass.operators.cumulative import (
    cumulative_backfill,
    cumulative_bootstrap_multi,
    cumulative_step,
    cumulative_step_multi,
    items_by_period,
    with_items,
    first_to_last_ratio,
    history_unnest,
)
from tallyglass.operators.datelist import activity_datelist_step, datelist_int, host_datelist_step
from tallyglass.operators.dedup import dedup_keep_one, device_days, distinct_on
from tallyglass.operators.edges import build_edges
from tallyglass.operators.monthly import daily_measures, monthly_array_rollup, monthly_array_step
from tallyglass.operators.scd import scd2_backfill, scd2_step
from tallyglass.operators.sessions import session_avg, session_compare
from tallyglass.operators.states import state_track_step
from tallyglass.operators.windows import longest_streak, rolling_wins_max
from tallyglass.sources.schemas import GRADES, TABLES, schema

# Class bounds of players (points) and actors (average rating),
# and the game counts and points of the two window questions.
PLAYER_BOUNDS = ((20, "star"), (15, "good"), (10, "average"))
ACTOR_BOUNDS = ((8, "star"), (7, "good"), (6, "average"))
STRETCH_GAMES = 90
STREAK_POINTS = 10
CUBE_LABELS = {"player_name": "All Players", "team": "All Teams", "season": "All Seasons"}

_PLAYER_STATIC = ["height", "college", "country", "draft_year", "draft_round", "draft_number"]
_PLAYER_STATS = ["gp", "pts", "reb", "ast"]
_PLAYER_NAMES = {
    "history": "season_stats",
    "grade": "scoring_class",
    "periods_since_active": "years_since_last_active",
    "season": "current_season",
}
_ACTOR_ITEM = ["film", "votes", "rating", "filmid"]


def _shaped(df: DataFrame, table: str, *more: str) -> DataFrame:
    return df.select(*schema(table).names, *more)


def _player_grade() -> Column:
    return one_of(grade(F.col("pts"), PLAYER_BOUNDS, "bad"), GRADES, "scoring_class")


def players_step(players: DataFrame, player_seasons: DataFrame, season: int) -> DataFrame:
    """``players`` rows of ``season`` from those of the season before."""
    prev = players.filter(F.col("current_season") == season - 1).withColumnsRenamed(
        {new: old for old, new in _PLAYER_NAMES.items()}
    )
    today = player_seasons.filter(F.col("season") == season)
    step = cumulative_step(prev, today, ["player_name"], "season", _PLAYER_STATS, _player_grade(), _PLAYER_STATIC)
    return _shaped(step.withColumnsRenamed(_PLAYER_NAMES), "players")


def players_backfill(
    player_seasons: DataFrame, first: int = 1996, last: int = 2022, static_rule: str = "latest"
) -> DataFrame:
    """``players`` rows of all seasons."""
    rows = cumulative_backfill(
        player_seasons, ["player_name"], "season", first, last, _PLAYER_STATS, _player_grade(), _PLAYER_STATIC, static_rule
    )
    return _shaped(rows.withColumnsRenamed(_PLAYER_NAMES), "players")


def player_history(players: DataFrame, season: int) -> DataFrame:
    """One row per player and season played, as of ``season``."""
    return history_unnest(players.filter(F.col("current_season") == season), ["player_name"], "season_stats")


def most_improved(players: DataFrame, season: int, grades: Sequence[str] = ("star",)) -> DataFrame:
    """Last season's points over the first's, largest first."""
    named = players.withColumnRenamed("scoring_class", "grade")
    return first_to_last_ratio(named, ["player_name"], "pts", "current_season", season, grades, "season_stats")


def players_scd_backfill(players: DataFrame, season: int) -> DataFrame:
    return scd2_backfill(
        players, ["player_name"], "current_season", ["scoring_class", "is_active"], season,
        "start_season", "end_season", "current_season",
    )


def players_scd_step(scd: DataFrame, players: DataFrame, season: int) -> DataFrame:
    return scd2_step(
        scd, players, ["player_name"], "current_season", ["scoring_class", "is_active"], season,
        "start_season", "end_season", "current_season",
    )


def _actor_grade(score: Column) -> Column:
    return one_of(grade(score, ACTOR_BOUNDS, "bad"), GRADES, "quality_class")


def _actor_args() -> dict:
    return {
        "keys": ["actorid"],
        "period": "year",
        "average": F.col("rating"),
        "grade": _actor_grade,
        "label": ["actor"],
    }


def actor_items(actor_films: DataFrame, parts: int = 1) -> DataFrame:
    """Film arrays per actor and year, as they are stored: each year once."""
    return items_by_period(actor_films, ["actorid"], "year", _ACTOR_ITEM, ["filmid"], parts, "films")


def _actors_out(rows: DataFrame) -> DataFrame:
    renamed = rows.withColumnsRenamed({"grade": "quality_class", "year": "film_year"})
    return _shaped(renamed, "actors")


def actors_step(actors: DataFrame, actor_films: DataFrame, year: int) -> DataFrame:
    """``actors`` rows of ``year``, one per actor; ``films`` is the view of a career's films in one array."""
    prev = actors.filter(F.col("film_year") == year - 1).withColumnsRenamed({"quality_class": "grade", "film_year": "year"})
    state = cumulative_step_multi(prev, actor_films, at=year, **_actor_args())
    added = actor_items(actor_films.filter(F.col("year") == year)).select("actorid", F.col("films").alias("_added"))
    kept = full_join(added, prev.select("actorid", F.col("films").alias("_kept")), ["actorid"])
    nothing = F.array().cast(actors.schema["films"].dataType)
    films = F.concat(*[F.coalesce(c, nothing) for c in ("_kept", "_added")])
    return _actors_out(full_join(state, kept.select("actorid", films.alias("films")), ["actorid"]))


def actors_bootstrap(actor_films: DataFrame, year: int) -> DataFrame:
    """``actors`` rows of ``year`` from all films up to it."""
    state = cumulative_bootstrap_multi(actor_films, at=year, **_actor_args())
    return _actors_out(with_items(state, actor_items(actor_films), ["actorid"], "year", year, "films"))


def _actor_states(actors: DataFrame) -> DataFrame:
    return actors.withColumnRenamed("film_year", "year")


def actors_scd_backfill(actors: DataFrame, year: int) -> DataFrame:
    rows = scd2_backfill(
        _actor_states(actors), ["actor", "actorid"], "year", ["quality_class", "is_active"], year,
        "start_year", "end_year", "current_year",
    )
    return _shaped(rows, "actor_history_scd")


def actors_scd_step(scd: DataFrame, actors: DataFrame, year: int) -> DataFrame:
    rows = scd2_step(
        scd, _actor_states(actors), ["actor", "actorid"], "year", ["quality_class", "is_active"], year,
        "start_year", "end_year", "current_year",
    )
    return _shaped(rows, "actor_history_scd")


def unique_game_details(game_details: DataFrame) -> DataFrame:
    """One row per game, team and player."""
    others = [c for c in game_details.columns if c not in ("game_id", "team_id", "player_id")]
    return dedup_keep_one(game_details, ["game_id", "team_id", "player_id"], others)


def unique_events(events: DataFrame) -> DataFrame:
    return distinct_on(events, ["user_id", "device_id", "host", "event_time"])


def user_devices_step(cumulated: DataFrame, devices: DataFrame, events: DataFrame, day: str) -> DataFrame:
    """``user_devices_cumulated`` rows of ``day``."""
    keys = ["user_id", "device_id", "browser_type"]
    todays = events.filter(F.to_date("event_time") == F.lit(day).cast("date"))
    active = device_days(devices, todays, keys)
    return _shaped(activity_datelist_step(cumulated, active, keys, day), "user_devices_cumulated")


def user_device_bits(cumulated: DataFrame, day: str, top_bit_age: int = 0) -> DataFrame:
    keys = ["user_id", "device_id", "browser_type"]
    return datelist_int(cumulated, keys, "device_activity_datelist", day, top_bit_age)


def user_bits(users_cumulated: DataFrame, day: str, top_bit_age: int = 0) -> DataFrame:
    return datelist_int(users_cumulated, ["user_id"], "dates_active", day, top_bit_age)


def hosts_step(cumulated: DataFrame, events: DataFrame, day: str) -> DataFrame:
    """``hosts_cumulated`` rows of ``day``."""
    active = events.select("host", F.to_date("event_time").alias("active_date"))
    return _shaped(host_datelist_step(cumulated, active, ["host"], day), "hosts_cumulated")


def hosts_reduced_step(reduced: DataFrame, events: DataFrame, day: str) -> DataFrame:
    """The month's ``hosts_activity_reduced`` rows after ``day``."""
    measures = {"hits": F.count(F.lit(1)), "visitors": F.count_distinct("user_id")}
    daily = daily_measures(events, ["host"], F.to_date("event_time"), day, measures)
    arrays = {"hits": "hit_array", "visitors": "unique_visitors"}
    return _shaped(monthly_array_step(reduced, daily, ["host"], day, arrays), "hosts_activity_reduced")


def array_metrics_step(metrics: DataFrame, events: DataFrame, day: str, metric: str = "site_hits") -> DataFrame:
    """The month's ``array_metrics`` rows of one metric after ``day``."""
    known = events.filter(F.col("user_id").isNotNull()).withColumn("metric_name", F.lit(metric))
    keys = ["user_id", "metric_name"]
    daily = daily_measures(known, keys, F.to_date("event_time"), day, {"hits": F.count(F.lit(1))})
    prev = metrics.filter(F.col("metric_name") == metric)
    return _shaped(monthly_array_step(prev, daily, keys, day, {"hits": "metric_array"}), "array_metrics")


def metric_by_day(metrics: DataFrame) -> DataFrame:
    """Sum over users per metric and date."""
    return monthly_array_rollup(metrics, ["metric_name"], "metric_array")


def player_state_step(player_state: DataFrame, player_seasons: DataFrame, season: int) -> DataFrame:
    """``player_state`` rows of ``season``."""
    prev = player_state.filter(F.col("current_season") == season - 1).withColumnRenamed("current_season", "season")
    today = player_seasons.filter(F.col("season") == season)
    step = state_track_step(prev, today, ["player_name"], "season", ["height", "college", "country"])
    return _shaped(step.withColumnRenamed("season", "current_season"), "player_state")


def _won() -> Column:
    home = (F.col("team_id") == F.col("home_team_id")) & (F.col("home_team_wins") == 1)
    away = (F.col("team_id") == F.col("visitor_team_id")) & (F.col("home_team_wins") == 0)
    return F.when(home | away, 1).otherwise(0)


def game_aggregates(game_details: DataFrame, games: DataFrame) -> DataFrame:
    """Points and wins by player and team, player and season, and team.

    ``total_wins`` counts player rows of won games, ``games_won`` games.
    """
    rows = game_details.filter(F.col("pts").isNotNull()).join(games, "game_id").select(
        "player_name", F.col("team_abbreviation").alias("team"), "season", "pts", "game_id", _won().alias("won")
    )
    measures = {
        "total_points": F.sum("pts"),
        "total_wins": F.sum("won"),
        "games_won": F.count_distinct(F.when(F.col("won") == 1, F.col("game_id"))),
    }
    sets = [["player_name", "team"], ["player_name", "season"], ["team"]]
    return grouping_sets_cube(rows, sets, measures, CUBE_LABELS)


def top_scorer_for_team(cube: DataFrame) -> DataFrame:
    return cube_top(cube, CUBE_LABELS, ["player_name", "team"], "total_points")


def top_scorer_in_season(cube: DataFrame) -> DataFrame:
    return cube_top(cube, CUBE_LABELS, ["player_name", "season"], "total_points")


def most_winning_team(cube: DataFrame) -> DataFrame:
    return cube_top(cube, CUBE_LABELS, ["team"], "games_won")


def most_wins_in_stretch(game_details: DataFrame, games: DataFrame, n: int = STRETCH_GAMES) -> DataFrame:
    """Most games any team won in ``n`` consecutive games."""
    teams = distinct_on(game_details, ["game_id", "team_id", "team_abbreviation"])
    results = teams.join(games, "game_id").select("team_abbreviation", "game_date_est", "game_id", _won().alias("won"))
    name = f"most_wins_in_{n}_game_stretch"
    return rolling_wins_max(results, ["team_abbreviation"], ["game_date_est", "game_id"], "won", n, name)


def scoring_streak(game_details: DataFrame, games: DataFrame, player: str, points: int = STREAK_POINTS) -> DataFrame:
    """Most consecutive games in which ``player`` scored over ``points``."""
    own = unique_game_details(game_details.filter(F.col("player_name") == player))
    rows = own.join(games, "game_id").select("player_name", "game_date_est", "game_id", "team_id", "pts")
    name = f"max_consecutive_games_over_{points}_points"
    order = ["game_date_est", "game_id", "team_id"]
    return longest_streak(rows, ["player_name"], order, F.col("pts") > points, name)


def game_edges(game_details: DataFrame) -> DataFrame:
    """A ``plays_in`` edge per player and game, from the row with most points."""
    order = [F.col("pts").desc_nulls_last(), "team_id", "team_abbreviation", "start_position"]
    props = ["start_position", "pts", "team_id", "team_abbreviation"]
    return build_edges(game_details, "player_id", "game_id", "plays_in", props, order, "player", "game")


def match_medals_joined(
    matches: DataFrame, match_details: DataFrame, medals_players: DataFrame, medals: DataFrame, maps: DataFrame,
    n_buckets: int = 16,
) -> DataFrame:
    """Players of all matches with their medals, from bucketed tables."""
    on = ["match_id", "player_gamertag"]
    tables = {
        "match_details_bucketed": match_details.join(matches, "match_id"),
        "medal_matches_player_bucketed": medals_players,
    }
    names = medals.withColumnRenamed("name", "medal_name")
    return bucketed_fact_join(tables, on, n_buckets, [(names, "medal_id"), (maps, "mapid")])


def top_killer(match_details: DataFrame) -> DataFrame:
    return top_avg_per_game(match_details, "player_gamertag", "match_id", "player_total_kills", "avg_kills_per_game")


def top_playlist(matches: DataFrame) -> DataFrame:
    return most_played(matches, "playlist_id", "match_id")


def top_map(matches: DataFrame) -> DataFrame:
    return most_played(matches, "mapid", "match_id")


def top_map_for_medal(
    matches: DataFrame, medals_players: DataFrame, medals: DataFrame, medal: str = "Killing Spree"
) -> DataFrame:
    """The map on which players got most medals of one name."""
    wanted = medals.filter(F.col("name") == medal).select("medal_id", F.col("name").alias("medal_name"))
    rows = medals_players.join(broadcast_checked(wanted), "medal_id").join(matches.select("match_id", "mapid"), "match_id")
    return top_filtered_sum(rows, F.col("medal_name") == medal, "mapid", "count", "medal_count")


def average_session(sessions: DataFrame, suffix: str) -> DataFrame:
    return session_avg(sessions, "host", suffix)


def compare_hosts(sessions: DataFrame, hosts: Sequence[str]) -> DataFrame:
    return session_compare(sessions, "host", hosts)


def empty_table(spark, table: str) -> DataFrame:
    """A state table before its first row."""
    extra = ", segment bigint" if table == "actors" else ""
    return spark.createDataFrame([], TABLES[table] + extra)
