"""The warehouse's tables in the catalog, and the jobs that load them.

``run_job(spark, "players", 2001)`` reads the job's tables from the catalog and
replaces the partitions its result has.  Running a job again gives the same
table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tallyglass.plans import warehouse as wh
from tallyglass.session import fresh_path
from tallyglass.sources.schemas import KEYS, TABLES
from tallyglass.sources.tables import assert_unique, create_table, overwrite_table, remove_path

# Partition columns of the tables the jobs write.
PARTITIONS = {
    "players": ["current_season"],
    "players_scd": ["current_season"],
    "actors": ["film_year"],
    "actor_history_scd": ["current_year"],
    "user_devices_cumulated": ["date"],
    "hosts_cumulated": ["date"],
    "hosts_activity_reduced": ["month_start"],
    "array_metrics": ["month_start", "metric_name"],
    "player_state": ["current_season"],
    "game_aggregates": [],
    "game_details_edge": [],
    "deduped_events": [],
}

Read = Callable[[str], DataFrame]

# Job: the table it loads and the rows for a period or day.
JOBS: dict[str, tuple[str, Callable[[Read, Any], DataFrame]]] = {
    "players": ("players", lambda read, at: wh.players_step(read("players"), read("player_seasons"), at)),
    "players_scd": ("players_scd", lambda read, at: wh.players_scd_step(read("players_scd"), read("players"), at)),
    "players_scd_backfill": ("players_scd", lambda read, at: wh.players_scd_backfill(read("players"), at)),
    "actors": ("actors", lambda read, at: wh.actors_step(read("actors"), read("actor_films"), at)),
    "actor_history_scd": (
        "actor_history_scd", lambda read, at: wh.actors_scd_step(read("actor_history_scd"), read("actors"), at),
    ),
    "actor_history_scd_backfill": ("actor_history_scd", lambda read, at: wh.actors_scd_backfill(read("actors"), at)),
    "user_devices_cumulated": (
        "user_devices_cumulated",
        lambda read, at: wh.user_devices_step(read("user_devices_cumulated"), read("devices"), read("events"), at),
    ),
    "hosts_cumulated": ("hosts_cumulated", lambda read, at: wh.hosts_step(read("hosts_cumulated"), read("events"), at)),
    "hosts_activity_reduced": (
        "hosts_activity_reduced", lambda read, at: wh.hosts_reduced_step(read("hosts_activity_reduced"), read("events"), at),
    ),
    "array_metrics": ("array_metrics", lambda read, at: wh.array_metrics_step(read("array_metrics"), read("events"), at)),
    "player_state": ("player_state", lambda read, at: wh.player_state_step(read("player_state"), read("player_seasons"), at)),
    "game_aggregates": ("game_aggregates", lambda read, at: wh.game_aggregates(read("game_details"), read("games"))),
    "game_details_edge": ("game_details_edge", lambda read, at: wh.game_edges(read("game_details"))),
    "deduped_events": ("deduped_events", lambda read, at: wh.unique_events(read("events"))),
}


def create_state_tables(spark: SparkSession, root: str, names: Iterable[str] = tuple(PARTITIONS)) -> None:
    """Create the tables the jobs write, under the folder ``root``."""
    for name in names:
        create_table(spark, name, TABLES[name], PARTITIONS[name], f"{root}/{name}")


def run_job(spark: SparkSession, job: str, at: Any = None) -> DataFrame:
    """Run one job for a period or day, and return the table it loads.

    The rows are staged once; a table with a key in ``KEYS`` is left as it is if they hold one twice.
    """
    target, rows = JOBS[job]
    staged = fresh_path(spark, job)
    try:
        built = rows(spark.table, at)
        built.write.parquet(staged)
        ready = spark.read.schema(built.schema).parquet(staged)
        if target in KEYS:
            assert_unique(ready, KEYS[target])
        overwrite_table(ready, target)
    finally:
        remove_path(spark, staged)
    return spark.table(target)
