from pyspark.sql import functions as F
from pyspark.testing import assertDataFrameEqual

import pytest

from tallyglass.functions.columns import grade
from tallyglass.operators.cumulative import (
    cumulative_backfill,
    cumulative_bootstrap_multi,
    cumulative_step,
    cumulative_step_multi,
    first_to_last_ratio,
    history_unnest,
    items_by_period,
    with_items,
)
from tallyglass.plans.periods import empty_snapshot, run_periods, run_periods_bucketed
from tallyglass.session import fresh_path
from tests.conftest import rows_of

BOUNDS = [(20, "star"), (15, "good"), (10, "average")]
FACTS = "name string, season int, pts int, town string, club string"
SNAPSHOT = (
    "name string, town string, club string, history array<struct<season:int,pts:int>>, grade string, "
    "periods_since_active int, is_active boolean, season int"
)


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(
        [
            ("ann", 2000, 21, "A", None),
            ("ann", 2001, 20, "B", "x"),
            ("ann", 2004, 11, None, "y"),  # back after a gap of two
            ("bob", 2001, 15, "C", "z"),  # exactly on a bound
            ("bob", 2002, 16, "B", None),
            ("cid", 2003, None, None, None),
            ("dot", 2002, 10, "D", "q"),
        ],
        FACTS,
    )


def backfill(facts, last=2004, rule="latest"):
    return cumulative_backfill(
        facts, ["name"], "season", 2000, last, ["pts"], grade(F.col("pts"), BOUNDS, "bad"), ["town", "club"], rule
    )


def test_step_new_returning_inactive(spark, facts):
    prev = backfill(facts).filter("season = 2003")
    out = cumulative_step(
        prev, facts.filter("season = 2004"), ["name"], "season", ["pts"], grade(F.col("pts"), BOUNDS, "bad"), ["town", "club"]
    )
    got = {r.name: r for r in out.collect()}
    ann = got["ann"]
    assert [tuple(h) for h in ann.history] == [(2000, 21), (2001, 20), (2004, 11)]
    assert (ann.town, ann.club, ann.grade, ann.periods_since_active, ann.is_active) == ("B", "y", "average", 0, True)
    bob = got["bob"]
    assert (bob.grade, bob.periods_since_active, bob.is_active, bob.season) == ("good", 2, False, 2004)
    assert got["cid"].grade == "bad" and got["dot"].grade == "bad"


def test_fold_of_steps_equals_backfill(spark, facts, tmp_path):
    schema = empty_snapshot(spark, SNAPSHOT).schema

    def step(prev, season):
        return cumulative_step(
            prev, facts.filter(F.col("season") == season), ["name"], "season", ["pts"],
            grade(F.col("pts"), BOUNDS, "bad"), ["town", "club"],
        )

    path = str(tmp_path / "snapshots")
    folded = run_periods(spark, path, schema, "season", range(2000, 2005), step)
    expected = backfill(facts).select(*schema.names)
    assertDataFrameEqual(folded.select(*schema.names), expected)
    # Running a period again changes nothing.
    again = run_periods(spark, path, schema, "season", [2003], step)
    assertDataFrameEqual(again.select(*schema.names), expected)


def test_bucketed_snapshots_are_not_shuffled_again(spark, facts):
    schema = empty_snapshot(spark, SNAPSHOT).schema
    plans = []

    def step(prev, season):
        out = cumulative_step(
            prev.hint("merge"), facts.filter(F.col("season") == season), ["name"], "season", ["pts"],
            grade(F.col("pts"), BOUNDS, "bad"), ["town", "club"], bucketed=True,
        )
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    path = fresh_path(spark, "bucketed")
    spark.sql("DROP TABLE IF EXISTS bucketed_people")
    folded = run_periods_bucketed(
        spark, "bucketed_people", path, schema, "season", range(2000, 2005), step, ["name"], 4
    )
    assertDataFrameEqual(folded.select(*schema.names), backfill(facts).select(*schema.names))
    # one for the new rows; the rows with a NULL key are joined apart
    assert all(p.count("Exchange hashpartitioning(name#") == 1 and "Bucketed: true" in p for p in plans)
    spark.sql("DROP TABLE bucketed_people")


def test_max_static_and_no_rows_before_debut(facts):
    rows = backfill(facts, rule="max")
    assert rows_of(rows.filter("name = 'ann' and season = 2000"), "town", "club") == [("B", "y")]
    assert rows_of(rows.groupBy("name").agg(F.min("season"))) == [("ann", 2000), ("bob", 2001), ("cid", 2003), ("dot", 2002)]
    assert rows.count() == 5 + 4 + 2 + 3


def test_backfill_rejects_a_repeated_period(spark, facts):
    with pytest.raises(Exception, match="more than one row"):
        backfill(facts.unionByName(facts.filter("name = 'bob'"))).collect()


def test_unnest_and_ratio(facts):
    last = backfill(facts).filter("season = 2004")
    assert history_unnest(last, ["name"]).count() == 7
    ratio = first_to_last_ratio(last, ["name"], "pts", "season", 2004)
    assert [(r.name, r.ratio) for r in ratio.collect()] == [
        ("bob", 16 / 15), ("dot", 1.0), ("ann", 11 / 21), ("cid", None),
    ]


FILMS = "actor string, actorid string, film string, year int, votes int, rating double, filmid string"
ITEM = ["film", "votes", "rating", "filmid"]
MULTI = "actorid string, actor string, grade string, is_active boolean, year int"


def multi():
    return {
        "keys": ["actorid"], "period": "year", "average": F.col("rating"),
        "grade": lambda s: grade(s, [(8, "star"), (7, "good"), (6, "average")], "bad"), "label": ["actor"],
    }


@pytest.fixture(scope="module")
def films(spark):
    rows = [
        ("Ann", "a", "f1", 2000, 5, 8.0, "1"),  # average exactly 8 is good
        ("Ann", "a", "f2", 2000, 5, 8.0, "2"),
        ("Anna", "a", "f3", 2002, 5, 9.0, "3"),
        (None, "b", "f4", 2001, 5, 6.5, "4"),
        ("Nil", None, "f5", 2000, 5, 9.5, "5"),
        ("Nil", None, "f6", 2001, 5, 6.5, "6"),
    ]
    rows += [(f"n{i}", "h", f"g{y}-{i:03d}", y, i, 5.0 + i % 5, f"{y}-{i}") for y in (2000, 2001) for i in range(100)]
    return spark.createDataFrame(rows, FILMS)


def test_multi_fold_equals_bootstrap(spark, films):
    columns = empty_snapshot(spark, MULTI).columns
    state = empty_snapshot(spark, MULTI)
    for year in range(2000, 2003):
        state = cumulative_step_multi(state, films, at=year, **multi())
        boot = cumulative_bootstrap_multi(films, at=year, **multi())
        assert rows_of(state, *columns) == rows_of(boot, *columns)
    got = {r.actorid: (r.actor, r.grade, r.is_active) for r in state.collect()}
    assert got == {
        "a": ("Anna", "star", True), "b": (None, "average", False), "h": ("n99", "average", False), None: ("Nil", "average", False),
    }


@pytest.mark.parametrize("parts", [1, 4])
def test_items_hold_every_row_once(spark, films, parts):
    stored = items_by_period(films, ["actorid"], "year", ITEM, ["filmid"], parts)
    rows = stored.collect()
    assert len({(r.actorid, r.year, r.part) for r in rows}) == len(rows)
    assert {r.part for r in rows if r.actorid == "h"} == set(range(parts))
    got = sorted((str(r.actorid), r.year, i.filmid) for r in rows for i in r["items"])
    assert got == sorted((str(r.actorid), r.year, r.filmid) for r in films.collect())
    state = cumulative_bootstrap_multi(films, at=2002, **multi())
    view = {r.actorid: [i.film for i in r["items"]] for r in with_items(state, stored, ["actorid"], "year", 2002).collect()}
    assert view["a"] == ["f1", "f2", "f3"] and view[None] == ["f5", "f6"] and len(view["h"]) == 200 and view["h"] == sorted(view["h"])
