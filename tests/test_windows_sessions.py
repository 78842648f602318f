"""Ordered operators against brute force, with one key holding a third of the rows or more."""

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import pytest

from __spark_entry__ import queries
from tallyglass.operators.sessions import session_avg, session_check, session_compare, sessionize_batch
from tallyglass.operators.windows import longest_streak, rolling_sum_max, rolling_wins_max
from tests.conftest import rows_of


@pytest.fixture(scope="module")
def games(spark):
    rng = random.Random(7)
    rows = [("hot", i // 3, i, rng.choice([True, True, True, False, None])) for i in range(3000)]
    rows += [("long", i, i, i != 100) for i in range(700)]
    rows += [("none", i, i, False) for i in range(40)]
    rows += [("end", i, i, i >= 35) for i in range(50)]
    rows += [(None, i, i, rng.random() < 0.8) for i in range(300)]
    rows += [(f"k{j}", i, i, rng.random() < 0.6) for j in range(60) for i in range(rng.randint(1, 12))]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def games_df(spark, games):
    return spark.createDataFrame(games, "team string, day int, game int, won boolean").repartition(6)


def by_key(rows):
    groups = {}
    for team, day, game, won in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        groups.setdefault(team, []).append(bool(won))
    return groups


@pytest.mark.parametrize("partitions,hot_rows", [(4, 10**6), (4, 100), (37, 0), (1, 0)])
def test_longest_streak_equals_brute_force(spark, games, games_df, partitions, hot_rows):
    expected = []
    for team, wins in by_key(games).items():
        best = run = 0
        for w in wins:
            run = run + 1 if w else 0
            best = max(best, run)
        expected.append((team, best or None))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(longest_streak(games_df, ["team"], ["day", "game"], F.col("won"), hot_rows=hot_rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sorted(expected, key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize(
    "partitions,n,hot_rows", [(4, 90, 10**6), (1, 5, 0), (4, 90, 100), (37, 90, 0), (37, 1, 0), (90, 400, 0)]
)
def test_rolling_sum_equals_brute_force(spark, games, games_df, partitions, n, hot_rows):
    expected = {}
    for team, wins in by_key(games).items():
        values = [2 * w - 1 for w in wins]  # negative values too
        expected[team] = max(sum(values[max(0, i - n + 1) : i + 1]) for i in range(len(values)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        value = F.when(F.col("won"), 1).otherwise(-1)
        got = rolling_sum_max(games_df, ["team"], ["day", "game"], value, n, "best", hot_rows).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert {r.team: r.best for r in got} == expected


def test_a_hot_key_is_cut_into_chunks(spark, games_df):
    from tallyglass.operators.windows import _chunked

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = _chunked(games_df, ["team"], ["day", "game"]).groupBy("_chunk").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 2 * games_df.count() / 4


def test_wins_max_counts_a_game_once(spark):
    rows = [("t", d, 1) for d in range(5)] * 3 + [("t", 2, 0)]
    df = spark.createDataFrame(rows, "team string, day int, won int")
    assert rolling_wins_max(df, ["team"], ["day"], "won", 3).collect()[0][0] == 3
    assert rolling_wins_max(df, ["team"], ["day"], "won", 90).collect()[0][0] == 5


@pytest.mark.parametrize("parts,n,hot_rows", [(5, 90, 10**6), (5, 90, 100), (23, 7, 0)])
def test_rolling_sum_in_given_parts_equals_brute_force(games, games_df, parts, n, hot_rows):
    expected = {}
    for team, wins in by_key(games).items():
        expected[team] = max(sum(wins[max(0, i - n + 1) : i + 1]) for i in range(len(wins)))
    value = F.when(F.col("won"), 1).otherwise(0)
    got = rolling_sum_max(games_df, ["team"], ["day", "game"], value, n, "best", hot_rows, parts).collect()
    assert {r.team: r.best for r in got} == expected
    assert rolling_wins_max(
        games_df.select("team", "day", "game", value.alias("won")), ["team"], ["day", "game"], "won", n, "best", hot_rows, parts
    ).collect()[0][0] == max(expected.values())


@pytest.mark.parametrize("name", ["rolling_wins_max", "rolling_wins_max_by_team"])
def test_partitions_of_rolling_wins_grow_with_the_rows(spark, sf_dir, monkeypatch, name):
    from tallyglass.functions.skew import parts_for
    from tallyglass.plans import game_queries

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    assert parts_for(rows, 500) == -(-rows.count() // 500) > parts_for(rows) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(game_queries, "parts_for", lambda df: parts_for(df, 500))
    df = queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((team_id#\d+L(?:, game_id#\d+L)?), (\d+)\), REPARTITION_BY_NUM", plan)
    assert {keys.count(",") for keys, _ in dealt} == {0, 1} and {n for _, n in dealt} == {str(parts_for(rows, 500))}
    # nothing is grouped before the rows are dealt out
    assert re.search(r"REPARTITION_BY_NUM[^\n]*\n[^\n]*(Project|BroadcastHashJoin)", plan)
    monkeypatch.undo()
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, queries()[name](spark, sf_dir).collect()))


START = datetime(2024, 1, 1)


def brute_sessions(rows, gap):
    out, last = [], {}
    for key, ts in sorted(rows):
        s = last.get(key)
        if s is None or (ts - s[2]).total_seconds() > gap:
            s = last[key] = [key, ts, ts, 0]
            out.append(s)
        s[2], s[3] = ts, s[3] + 1
    return sorted((k, a, z, n) for k, a, z, n in out)


def test_sessions_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [("hot", START + timedelta(seconds=rng.randint(0, 400_000))) for _ in range(2500)]
    rows += [(f"u{j}", START + timedelta(seconds=rng.randint(0, 50_000))) for j in range(30) for _ in range(20)]
    # Exactly one gap apart stays one session, one microsecond more opens another.
    rows += [("edge", START), ("edge", START + timedelta(seconds=300)), ("over", START), ("over", START + timedelta(seconds=300, microseconds=1))]
    # Before 1970, where slots must round down.
    rows += [("old", datetime(1969, 12, 31, 23, 58)), ("old", datetime(1970, 1, 1, 0, 2)), ("old", datetime(1970, 1, 1, 0, 8))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz").repartition(5)
    got = sessionize_batch(df, ["k"], "ts", 300).select("k", "session_start", "session_last", "num_hits")
    assert sorted(tuple(r) for r in got.collect()) == brute_sessions(rows, 300)
    check = session_check(df, got, "ts").collect()[0]
    assert check.agrees and check.session_hits == len(rows)


def test_session_statistics(spark):
    sessions = spark.createDataFrame(
        [("a.tech.io", 2), ("b.tech.io", 3), ("a.tech.io", 6), ("tech.org", 9)], "host string, num_hits bigint"
    )
    assert session_avg(sessions, "host", ".tech.io").collect()[0][0] == 11 / 3
    compared = session_compare(sessions, "host", ["a.tech.io", "tech.org", "absent"])
    assert [tuple(r) for r in compared.collect()] == [("a.tech.io", 4.0, 2, 8), ("tech.org", 9.0, 1, 9)]
