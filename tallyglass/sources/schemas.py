"""Schemas of the source, state and output tables, as Spark DDL."""

from __future__ import annotations

from pyspark.sql import types as T

# Labels the two class columns and the state column may hold.
GRADES = ("star", "good", "average", "bad")
PLAYER_STATES = (
    "New",
    "Continued Playing",
    "Retired",
    "Returned from Retirement",
    "Stayed Retired",
    "Unknown",
)

TABLES = {
    # sources
    "player_seasons": "player_name string, height string, college string, country string, draft_year string, "
    "draft_round string, draft_number string, season int, gp int, pts float, reb float, ast float",
    "actor_films": "actor string, actorid string, film string, year int, votes int, rating float, filmid string",
    "devices": "device_id bigint, browser_type string, os_type string",
    "events": "user_id bigint, device_id bigint, host string, event_time timestamp",
    "game_details": "game_id bigint, team_id bigint, team_abbreviation string, player_id bigint, "
    "player_name string, start_position string, pts int",
    "games": "game_id bigint, game_date_est date, season int, home_team_id bigint, visitor_team_id bigint, "
    "home_team_wins int",
    "match_details": "match_id string, player_gamertag string, previous_spartan_rank int, spartan_rank int, "
    "previous_total_xp int, total_xp int, previous_csr_tier int, previous_csr_designation int, previous_csr int, "
    "previous_csr_percent_to_next_tier int, previous_csr_rank int, current_csr_tier int, "
    "current_csr_designation int, current_csr int, current_csr_percent_to_next_tier int, current_csr_rank int, "
    "player_rank_on_team int, player_finished boolean, player_average_life string, player_total_kills int, "
    "player_total_headshots int, player_total_weapon_damage double, player_total_shots_landed int, "
    "player_total_melee_kills int, player_total_melee_damage double, player_total_assassinations int, "
    "player_total_ground_pound_kills int, player_total_shoulder_bash_kills int, "
    "player_total_grenade_damage double, player_total_power_weapon_damage double, "
    "player_total_power_weapon_grabs int, player_total_deaths int, player_total_assists int, "
    "player_total_grenade_kills int, did_win int, team_id int",
    "matches": "match_id string, mapid string, is_team_game boolean, playlist_id string, game_variant_id string, "
    "is_match_over boolean, completion_date timestamp, match_duration string, game_mode string, "
    "map_variant_id string",
    "medals_matches_players": "match_id string, player_gamertag string, medal_id bigint, count int",
    "medals": "medal_id bigint, name string",
    "maps": "mapid string",
    "web_traffic": "ip string, event_time string, referrer string, host string, url string, geodata string",
    # state and output
    "players": "player_name string, height string, college string, country string, draft_year string, "
    "draft_round string, draft_number string, "
    "season_stats array<struct<season:int,gp:int,pts:float,reb:float,ast:float>>, scoring_class string, "
    "years_since_last_active int, current_season int, is_active boolean",
    "players_scd": "player_name string, scoring_class string, is_active boolean, start_season int, "
    "end_season int, current_season int",
    "actors": "actor string, actorid string, films array<struct<film:string,votes:int,rating:float,filmid:string>>, "
    "quality_class string, is_active boolean, film_year int",
    "actor_history_scd": "actor string, actorid string, quality_class string, is_active boolean, start_year int, "
    "end_year int, current_year int",
    "user_devices_cumulated": "user_id bigint, device_id bigint, browser_type string, date date, "
    "device_activity_datelist array<date>",
    "users_cumulated": "user_id bigint, date date, dates_active array<date>",
    "hosts_cumulated": "host string, date date, host_activity_datelist array<date>",
    "array_metrics": "user_id bigint, month_start date, metric_name string, metric_array array<bigint>",
    "hosts_activity_reduced": "host string, month_start date, hit_array array<bigint>, unique_visitors array<bigint>",
    "player_state": "player_name string, height string, college string, country string, current_season int, "
    "player_status string",
    "game_aggregates": "player_name string, team string, season string, total_points bigint, total_wins bigint, "
    "games_won bigint",
    "game_details_edge": "subject_identifier bigint, subject_type string, object_identifier bigint, "
    "object_type string, edge_type string, properties map<string,string>",
    "deduped_events": "user_id bigint, device_id bigint, host string, event_time timestamp",
    "sessionized_aggregated_events": "event_hour timestamp, ip string, host string, num_hits bigint",
}

# Columns that identify a row; Spark does not enforce them, ``assert_unique`` checks.
KEYS = {
    "players": ("player_name", "current_season"),
    "players_scd": ("player_name", "start_season", "current_season"),
    "actors": ("actorid", "film_year"),
    "actor_history_scd": ("actorid", "start_year", "current_year"),
    "user_devices_cumulated": ("user_id", "device_id", "browser_type", "date"),
    "hosts_cumulated": ("host", "date"),
    "array_metrics": ("user_id", "month_start", "metric_name"),
    "hosts_activity_reduced": ("host", "month_start"),
    "player_state": ("player_name", "current_season"),
}


def schema(table: str) -> T.StructType:
    """Schema of a table of :data:`TABLES`."""
    return T.StructType.fromDDL(TABLES[table])
