"""Fact joins on bucketed tables, and top-one questions over the facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.skew import broadcast_checked
from tallyglass.operators.profile import top_one
from tallyglass.sources.tables import write_bucketed


def bucketed_fact_join(
    tables: Mapping[str, DataFrame],
    on: Sequence[str],
    n_buckets: int = 16,
    dims: Sequence[tuple[DataFrame, str]] = (),
) -> DataFrame:
    """Write each table bucketed on exactly the join key, and join them without an exchange.

    ``on`` should be the grain of the tables, so no join multiplies rows and no
    bucket fills up with one key: aggregate facts per ``on`` first, or name a
    second column (match and player, say) that spreads a large key.  ``dims``
    are (table, join column) pairs, broadcast if their size check allows it.
    """
    stored = [write_bucketed(table.sparkSession, table, name, n_buckets, on) for name, table in tables.items()]
    return kept_fact_join(stored, on, dims)


def kept_fact_join(
    tables: Sequence[DataFrame], on: Sequence[str], dims: Sequence[tuple[DataFrame, str]] = ()
) -> DataFrame:
    """Join bucketed tables in place, without an exchange.

    ``tables`` are scans of tables that :func:`tallyglass.sources.tables.keep_bucketed` keeps, bucketed on exactly ``on`` into
    as many buckets each; rows appended to them since are joined like the others.
    """
    joined = tables[0]
    for table in tables[1:]:
        joined = joined.hint("merge").join(table, list(on))
    for dim, column in dims:
        joined = joined.join(broadcast_checked(dim), column)
    return joined


def average_per_game(
    facts: DataFrame, player: str, game: str, measure: str, name: str = "avg_per_game"
) -> DataFrame:
    """Sum per player and game, then average per player."""
    per_game = facts.groupBy(player, game).agg(F.sum(measure).alias("_in_game"))
    return per_game.groupBy(player).agg(F.avg("_in_game").alias(name))


def top_avg_per_game(
    facts: DataFrame, player: str, game: str, measure: str, name: str = "avg_per_game"
) -> DataFrame:
    """The player with the highest average per game."""
    return top_one(average_per_game(facts, player, game, measure, name), name, [player])


def most_played(matches: DataFrame, by: str, match: str, name: str = "match_count") -> DataFrame:
    """The ``by`` value with the most distinct matches."""
    return top_one(matches.groupBy(by).agg(F.count_distinct(match).alias(name)), name, [by])


def top_filtered_sum(df: DataFrame, keep: Column, by: str, measure: str, name: str) -> DataFrame:
    """Among rows passing ``keep``, the ``by`` value with the largest sum."""
    return top_one(df.filter(keep).groupBy(by).agg(F.sum(measure).alias(name)), name, [by])
