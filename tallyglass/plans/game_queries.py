"""Bucketed joins, top-one questions, edges, cubes and ordered windows, on orders and line items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.skew import broadcast_checked, parts_for
from tallyglass.operators.bucketed import (
    average_per_game,
    kept_fact_join,
    most_played,
    top_avg_per_game,
    top_filtered_sum,
)
from tallyglass.operators.cube import grouped_top, grouping_sets_cube
from tallyglass.operators.edges import build_edges
from tallyglass.operators.windows import longest_streak, rolling_sum_max, rolling_wins_max
from tallyglass.plans.fact_queries import GAME_DETAILS, UNIQUE_DETAILS, unique_details
from tallyglass.plans.registry import query
from tallyglass.plans.warehouse import CUBE_LABELS, STRETCH_GAMES
from tallyglass.session import fresh_path
from tallyglass.sources.bindings import Tables
from tallyglass.sources.tables import files_mark, keep_bucketed

MATCHES = """matches AS (
  SELECT o_orderkey AS match_id, o_orderpriority AS playlist_id, CAST(o_custkey % 25 AS INTEGER) AS mapid FROM orders)"""
FACTS = f"""{GAME_DETAILS}, {MATCHES},
match_details AS (
  SELECT game_id AS match_id, team_id AS player_id, CAST(sum(pts) AS BIGINT) AS kills
  FROM game_details GROUP BY game_id, team_id),
match_medals AS (
  SELECT game_id AS match_id, team_id AS player_id, player_id AS medal_id, count(*) AS medal_count
  FROM game_details GROUP BY game_id, team_id, player_id)"""


def kept(t: Tables, name: str, build: Callable[[], DataFrame], on: list[str], n_buckets: int = 16) -> DataFrame:
    """A bucketed table of the folder's facts: written when first asked for, read in place from then on.

    Its name carries a mark of the folder's files, so changed files get a table of their own.
    """
    mark = files_mark(t.spark, [f"{t.sf_dir}/{source}.parquet" for source in ("orders", "lineitem")])
    table = f"{name}_{mark}_{n_buckets}"
    if t.spark.catalog.tableExists(table):
        return t.spark.table(table)
    return keep_bucketed(build(), table, n_buckets, on, path=fresh_path(t.spark, name))


def match_tables(t: Tables) -> list[DataFrame]:
    """Matches, and players and medals per match, kept bucketed by match."""

    def details():
        return t.match_details().groupBy("match_id").agg(F.count(F.lit(1)).alias("players"), F.sum("kills").alias("kills"))

    def medals():
        return t.match_medals().groupBy("match_id").agg(F.sum("medal_count").alias("medal_count"))

    on = ["match_id"]
    return [kept(t, "matches", t.matches, on), kept(t, "match_details", details, on), kept(t, "match_medals", medals, on)]


def player_tables(t: Tables) -> list[DataFrame]:
    """Facts per match and player, kept bucketed by both; the match's columns are stored with the first fact."""
    on = ["match_id", "player_id"]
    return [
        kept(t, "player_details", lambda: t.match_details().join(t.matches(), "match_id"), on),
        kept(t, "player_medals", t.match_medals, on),
    ]


@query(
    "bucketed_fact_join",
    f"""WITH {FACTS},
    details AS (SELECT match_id, count(*) AS players, CAST(sum(kills) AS BIGINT) AS kills FROM match_details GROUP BY match_id),
    medals AS (SELECT match_id, CAST(sum(medal_count) AS BIGINT) AS medal_count FROM match_medals GROUP BY match_id)
    SELECT match_id, playlist_id, mapid, players, kills, medal_count, n_name AS map_name
    FROM matches JOIN details USING (match_id) JOIN medals USING (match_id) JOIN nation ON n_nationkey = mapid""",
)
def q_bucketed(t: Tables):
    return kept_fact_join(match_tables(t), ["match_id"], dims=[(t.maps(), "mapid")])


@query(
    "bucketed_player_join",
    f"""WITH {FACTS}
    SELECT m.match_id, d.player_id, d.kills, g.medal_id, g.medal_count, m.playlist_id, m.mapid,
           p.p_name AS medal_name, n.n_name AS map_name
    FROM match_details d JOIN match_medals g USING (match_id, player_id) JOIN matches m USING (match_id)
    JOIN part p ON p.p_partkey = g.medal_id JOIN nation n ON n.n_nationkey = m.mapid""",
)
def q_bucketed_players(t: Tables):
    return kept_fact_join(player_tables(t), ["match_id", "player_id"], dims=[(t.medals(), "medal_id"), (t.maps(), "mapid")])


@query(
    "bucketed_match_lookup",
    f"""WITH {FACTS},
    wanted AS (SELECT max(match_id) AS match_id FROM matches)
    SELECT match_id, playlist_id, mapid, CAST(count(*) AS BIGINT) AS players, CAST(sum(kills) AS BIGINT) AS kills
    FROM matches JOIN match_details USING (match_id) JOIN wanted USING (match_id) GROUP BY ALL""",
)
def q_lookup(t: Tables):
    """The last match from the kept tables: of each, one bucket is read."""
    newest = t.matches().agg(F.max("match_id")).first()[0]
    matches, details, _ = match_tables(t)
    picked = [table.filter(F.col("match_id") == newest) for table in (matches, details)]
    return kept_fact_join(picked, ["match_id"]).select("match_id", "playlist_id", "mapid", "players", "kills")


@query(
    "top_avg_per_game",
    f"""WITH {FACTS}
    SELECT player_id, avg(kills) AS avg_kills_per_game FROM match_details GROUP BY player_id
    ORDER BY avg_kills_per_game DESC, player_id LIMIT 1""",
)
def q_top_avg(t: Tables):
    details = t.game_details().select(F.col("game_id").alias("match_id"), F.col("team_id").alias("player_id"), "pts")
    return top_avg_per_game(details, "player_id", "match_id", "pts", "avg_kills_per_game")


@query(
    "average_per_game",
    f"WITH {FACTS} SELECT player_id, avg(kills) AS avg_kills_per_game FROM match_details GROUP BY player_id",
)
def q_avg(t: Tables):
    details = t.game_details().select(F.col("game_id").alias("match_id"), F.col("team_id").alias("player_id"), "pts")
    return average_per_game(details, "player_id", "match_id", "pts", "avg_kills_per_game")


@query(
    "most_played_playlist",
    f"""WITH {MATCHES} SELECT playlist_id, count(DISTINCT match_id) AS match_count FROM matches GROUP BY playlist_id
    ORDER BY match_count DESC, playlist_id LIMIT 1""",
)
def q_playlist(t: Tables):
    return most_played(t.matches(), "playlist_id", "match_id")


@query(
    "most_played_map",
    f"""WITH {MATCHES} SELECT mapid, count(DISTINCT match_id) AS match_count FROM matches GROUP BY mapid
    ORDER BY match_count DESC, mapid LIMIT 1""",
)
def q_map(t: Tables):
    return most_played(t.matches(), "mapid", "match_id")


@query(
    "top_filtered_sum",
    f"""WITH {FACTS}
    SELECT mapid, CAST(sum(medal_count) AS BIGINT) AS medal_total FROM match_medals g JOIN matches m USING (match_id)
    JOIN part p ON p.p_partkey = g.medal_id WHERE p.p_name = 'small ring'
    GROUP BY mapid ORDER BY medal_total DESC, mapid LIMIT 1""",
)
def q_filtered(t: Tables):
    wanted = t.medals().filter(F.col("medal_name") == "small ring")
    given = t.game_details().select(
        F.col("game_id").alias("match_id"), F.col("player_id").alias("medal_id"), F.lit(1).alias("medal_count")
    )
    rows = given.join(broadcast_checked(wanted), "medal_id").join(t.matches(), "match_id")
    return top_filtered_sum(rows, F.col("medal_name") == "small ring", "mapid", "medal_count", "medal_total")


@query(
    "build_edges",
    f"""WITH {GAME_DETAILS},
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY player_id, game_id ORDER BY pts DESC, line_id, team_id,
             start_position, line_status, game_date, price_cents) AS rank_no FROM game_details) WHERE rank_no = 1)
    SELECT player_id AS subject_identifier, 'player' AS subject_type, game_id AS object_identifier, 'game' AS object_type,
           'plays_in' AS edge_type,
           'line_status=' || line_status || ';pts=' || pts || ';start_position=' || start_position || ';team_id=' || team_id AS properties
    FROM kept""",
)
def q_edges(t: Tables):
    edges = build_edges(
        t.game_details(),
        "player_id",
        "game_id",
        "plays_in",
        ["start_position", "pts", "team_id", "line_status"],
        [F.desc("pts"), "line_id", "team_id", "start_position", "line_status", "game_date", "price_cents"],
        "player",
        "game",
    )
    entries = F.array_sort(F.map_entries("properties"))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return edges.withColumn("properties", text)


LABELS = dict(zip(("player", "team", "season"), CUBE_LABELS.values(), strict=True))
SETS = [["player", "team"], ["player", "season"], ["team"]]
CUBE = f"""{GAME_DETAILS},
scored AS (
  SELECT d.player_id AS player, d.team_id AS team, CAST(year(o.o_orderdate) AS INTEGER) AS season, d.pts, d.game_id,
         d.start_position = 'A' AS won
  FROM game_details d JOIN orders o ON o.o_orderkey = d.game_id WHERE d.pts IS NOT NULL),
cube_rows AS (
  SELECT CASE WHEN grouping(player) = 1 THEN 'All Players' ELSE CAST(player AS VARCHAR) END AS player,
         CASE WHEN grouping(team) = 1 THEN 'All Teams' ELSE CAST(team AS VARCHAR) END AS team,
         CASE WHEN grouping(season) = 1 THEN 'All Seasons' ELSE CAST(season AS VARCHAR) END AS season,
         CAST(sum(pts) AS BIGINT) AS total_points, count(*) FILTER (WHERE won) AS total_wins,
         count(DISTINCT CASE WHEN won THEN game_id END) AS games_won
  FROM scored GROUP BY GROUPING SETS ((player, team), (player, season), (team)))"""


def scored(t: Tables):
    won = F.col("start_position") == "A"
    return (
        t.game_details()
        .filter(F.col("pts").isNotNull())
        .join(t.games(), "game_id")
        .select(F.col("player_id").alias("player"), F.col("team_id").alias("team"), "season", "pts", "game_id", won.alias("won"))
    )


def cube(t: Tables):
    measures = {"total_points": F.sum("pts"), "total_wins": F.count_if("won"), "games_won": games_won()}
    return grouping_sets_cube(scored(t), SETS, measures, LABELS)


def games_won():
    return F.count_distinct(F.when(F.col("won"), F.col("game_id")))


@query("grouping_sets_cube", f"WITH {CUBE} SELECT * FROM cube_rows")
def q_cube(t: Tables):
    return cube(t)


@query(
    "cube_top_player_team",
    f"""WITH {CUBE} SELECT player, team, total_points FROM cube_rows
    WHERE season = 'All Seasons' AND player <> 'All Players' ORDER BY total_points DESC, player, team LIMIT 1""",
)
def q_cube_player_team(t: Tables):
    return grouped_top(scored(t), ["player", "team"], F.sum("pts"), "total_points")


@query(
    "cube_top_player_season",
    f"""WITH {CUBE} SELECT player, season, total_points FROM cube_rows
    WHERE team = 'All Teams' ORDER BY total_points DESC, player, season LIMIT 1""",
)
def q_cube_player_season(t: Tables):
    return grouped_top(scored(t), ["player", "season"], F.sum("pts"), "total_points")


@query(
    "cube_top_team",
    f"""WITH {CUBE} SELECT team, games_won FROM cube_rows
    WHERE player = 'All Players' AND season = 'All Seasons' ORDER BY games_won DESC, team LIMIT 1""",
)
def q_cube_team(t: Tables):
    return grouped_top(scored(t), ["team"], games_won(), "games_won")


ROLLING = f"""{GAME_DETAILS},
games AS (SELECT team_id, min(game_date) AS game_date, game_id, max(CASE WHEN start_position = 'A' THEN 1 ELSE 0 END) AS won
          FROM game_details GROUP BY team_id, game_id),
rolling AS (SELECT team_id, CAST(sum(won) OVER (PARTITION BY team_id ORDER BY game_date, game_id
            ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) AS BIGINT) AS wins FROM games)"""


def results(t: Tables, parts: int):
    """One row per team and game, won if any of its rows says so; a game's day is its first row's.

    A team has few rows in a game, so rows are dealt out before they are grouped: a group per row in every input split
    would only fill memory.
    """
    won = F.when(F.col("start_position") == "A", 1).otherwise(0)
    rows = t.game_details().repartition(parts, "team_id", "game_id")
    return rows.groupBy("team_id", "game_id").agg(F.min("game_date").alias("game_date"), F.max(won).alias("won"))


@query("rolling_wins_max", f"WITH {ROLLING} SELECT max(wins) AS most_wins_in_stretch FROM rolling")
def q_rolling(t: Tables):
    parts = parts_for(t.lineitem)
    return rolling_wins_max(results(t, parts), ["team_id"], ["game_date", "game_id"], "won", STRETCH_GAMES, parts=parts)


@query(
    "rolling_wins_max_by_team",
    f"WITH {ROLLING} SELECT team_id, max(wins) AS most_wins_in_stretch FROM rolling GROUP BY team_id",
)
def q_rolling_team(t: Tables):
    order, parts = ["game_date", "game_id"], parts_for(t.lineitem)
    rows = results(t, parts)
    return rolling_sum_max(rows, ["team_id"], order, F.col("won"), STRETCH_GAMES, "most_wins_in_stretch", parts=parts)


@query(
    "longest_streak",
    f"""WITH {UNIQUE_DETAILS},
    flagged AS (SELECT team_id, game_date, game_id, line_id, coalesce(pts > 10, false) AS hit FROM unique_details),
    named AS (SELECT *, count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY team_id ORDER BY game_date, game_id, line_id
                      ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
    runs AS (SELECT team_id, count(*) AS n FROM named WHERE hit GROUP BY team_id, run)
    SELECT team_id, max(n) AS longest_streak FROM (SELECT DISTINCT team_id FROM flagged) LEFT JOIN runs USING (team_id) GROUP BY team_id""",
)
def q_streak(t: Tables):
    return longest_streak(unique_details(t), ["team_id"], ["game_date", "game_id", "line_id"], F.col("pts") > 10)
