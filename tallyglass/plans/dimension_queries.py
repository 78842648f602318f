"""Cumulative tables, slowly changing dimensions and states, on customers by year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions.columns import grade, one_of
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
from tallyglass.operators.scd import scd2_backfill, scd2_step
from tallyglass.operators.states import state_track_backfill, state_track_step
from tallyglass.plans.registry import query
from tallyglass.sources.bindings import Tables
from tallyglass.sources.schemas import GRADES

FIRST, LAST = 1995, 2001
KEYS = ["customer_id"]
STATS = ["order_count", "spend_cents"]
STATIC = ["priority", "last_order_id"]
SPEND_BOUNDS = [(60_000_000, "star"), (40_000_000, "good"), (20_000_000, "average")]
PRICE_BOUNDS = [(35_000_000, "star"), (25_000_000, "good"), (15_000_000, "average")]
ATTRS = ["grade", "is_active"]

ORDER_ROWS = """order_rows AS (
  SELECT o_custkey AS customer_id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS order_id,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, CAST(round(o_totalprice * 100) AS BIGINT) AS price_cents
  FROM orders)"""

SEASONS = f"""{ORDER_ROWS},
seasons AS (
  SELECT customer_id, year, CAST(count(*) AS INTEGER) AS order_count, CAST(sum(price_cents) AS BIGINT) AS spend_cents,
         max(priority) AS priority, max(order_id) AS last_order_id
  FROM order_rows GROUP BY customer_id, year)"""

GRID = """grid AS (
  SELECT d.customer_id, CAST(y.year AS INTEGER) AS year
  FROM (SELECT customer_id, min(year) AS debut FROM seasons GROUP BY customer_id) d
  JOIN (SELECT unnest(range(1995, 2002)) AS year) y ON d.debut <= y.year)"""

SNAPSHOTS = f"""{SEASONS},
{GRID},
placed AS (
  SELECT g.customer_id, g.year, s.year AS seen, s.priority, s.last_order_id,
         CASE WHEN s.spend_cents > 60000000 THEN 'star' WHEN s.spend_cents > 40000000 THEN 'good'
              WHEN s.spend_cents > 20000000 THEN 'average' WHEN s.year IS NOT NULL THEN 'bad' END AS grade,
         s.order_count, s.spend_cents
  FROM grid g LEFT JOIN seasons s ON s.customer_id = g.customer_id AND s.year = g.year),
snapshots AS (
  SELECT customer_id, year,
         last_value(priority IGNORE NULLS) OVER w AS priority,
         last_value(last_order_id IGNORE NULLS) OVER w AS last_order_id,
         string_agg(CASE WHEN seen IS NOT NULL THEN seen || ':' || order_count || ':' || spend_cents END, ',') OVER w AS history,
         last_value(grade IGNORE NULLS) OVER w AS grade,
         CAST(year - max(seen) OVER w AS INTEGER) AS periods_since_active,
         max(seen) OVER w = year AS is_active
  FROM placed WINDOW w AS (PARTITION BY customer_id ORDER BY year))"""

RUNS = """flagged AS (
  SELECT *, CASE WHEN lag(year) OVER w IS NULL THEN 0
                 WHEN grade IS DISTINCT FROM lag(grade) OVER w THEN 1
                 WHEN is_active IS DISTINCT FROM lag(is_active) OVER w THEN 1 ELSE 0 END AS change
  FROM snapshots WHERE year <= {upto} WINDOW w AS (PARTITION BY customer_id ORDER BY year)),
named AS (SELECT *, sum(change) OVER (PARTITION BY customer_id ORDER BY year) AS run FROM flagged)
SELECT customer_id, grade, is_active, min(year) AS start_year, max(year) AS end_year, {upto} AS current_year
FROM named GROUP BY customer_id, run, grade, is_active"""


def spend_grade() -> Column:
    return one_of(grade(F.col("spend_cents"), SPEND_BOUNDS, "bad"), GRADES, "grade")


def price_grade(score: Column) -> Column:
    return grade(score, PRICE_BOUNDS, "bad")


def snapshots(t: Tables, last: int, static_rule: str = "latest", static=STATIC):
    return cumulative_backfill(
        t.seasons(), KEYS, "year", FIRST, last, STATS, spend_grade(), static=static, static_rule=static_rule
    )


def history_text(df, column: str = "history", fields=("year", *STATS)):
    """Arrays as text, so both engines compare the same values."""
    element = F.transform(column, lambda e: F.concat_ws(":", *[e[f].cast("string") for f in fields]))
    return df.withColumn(column, F.array_join(element, ","))


@query("cumulative_backfill", f"WITH {SNAPSHOTS} SELECT * FROM snapshots")
def q_backfill(t: Tables):
    return history_text(snapshots(t, LAST))


@query(
    "cumulative_backfill_max_static",
    f"""WITH {SNAPSHOTS},
    fixed AS (SELECT customer_id, max(priority) AS priority, max(last_order_id) AS last_order_id FROM seasons GROUP BY customer_id)
    SELECT s.* REPLACE (f.priority AS priority, f.last_order_id AS last_order_id) FROM snapshots s JOIN fixed f USING (customer_id)""",
)
def q_backfill_max(t: Tables):
    return history_text(snapshots(t, LAST, static_rule="max"))


@query("cumulative_step", f"WITH {SNAPSHOTS} SELECT * FROM snapshots WHERE year = 2001")
def q_step(t: Tables):
    prev = snapshots(t, LAST - 1).filter(F.col("year") == LAST - 1)
    today = t.seasons().filter(F.col("year") == LAST)
    return history_text(cumulative_step(prev, today, KEYS, "year", STATS, spend_grade(), static=STATIC))


MULTI = f"""WITH {ORDER_ROWS},
per_year AS (SELECT customer_id, year, avg(price_cents) AS score, max(priority) AS priority
             FROM order_rows WHERE year <= {{at}} GROUP BY customer_id, year),
state AS (SELECT customer_id, max(year) AS last_year, arg_max(score, year) AS score, arg_max(priority, year) AS priority
          FROM per_year GROUP BY customer_id),
arrays AS (SELECT customer_id, string_agg(order_id || ':' || price_cents, ',' ORDER BY year, order_id) AS items
           FROM order_rows WHERE year <= {{at}} GROUP BY customer_id)
SELECT customer_id, priority, items,
       CASE WHEN score > 35000000 THEN 'star' WHEN score > 25000000 THEN 'good'
            WHEN score > 15000000 THEN 'average' ELSE 'bad' END AS grade,
       last_year = {{at}} AS is_active, CAST({{at}} AS INTEGER) AS year
FROM state JOIN arrays USING (customer_id)"""
MULTI_ARGS = {
    "keys": KEYS,
    "period": "year",
    "grade": price_grade,
    "label": ["priority"],
}


def order_items(t: Tables):
    return items_by_period(t.order_rows(), KEYS, "year", ["order_id", "price_cents"], ["order_id"], parts=4)


def with_order_items(t: Tables, state):
    """The state with the view of all items in one array."""
    return history_text(with_items(state, order_items(t), KEYS, "year", LAST), "items", ("order_id", "price_cents"))


@query("cumulative_step_multi", MULTI.format(at=2001))
def q_step_multi(t: Tables):
    rows = t.order_rows()
    prev = cumulative_bootstrap_multi(rows, at=LAST - 1, average=F.col("price_cents"), **MULTI_ARGS)
    return with_order_items(t, cumulative_step_multi(prev, rows, at=LAST, average=F.col("price_cents"), **MULTI_ARGS))


@query("cumulative_bootstrap_multi", MULTI.format(at=2001))
def q_bootstrap_multi(t: Tables):
    return with_order_items(t, cumulative_bootstrap_multi(t.order_rows(), at=LAST, average=F.col("price_cents"), **MULTI_ARGS))


@query(
    "cumulative_items_by_period",
    f"""WITH {ORDER_ROWS}
    SELECT customer_id, year, string_agg(order_id || ':' || price_cents, ',' ORDER BY order_id) AS items
    FROM order_rows GROUP BY customer_id, year""",
)
def q_items(t: Tables):
    items = items_by_period(t.order_rows(), KEYS, "year", ["order_id", "price_cents"], ["order_id"], parts=1)
    return history_text(items.drop("part"), "items", ("order_id", "price_cents"))


@query("history_unnest", f"WITH {SEASONS} SELECT customer_id, year, order_count, spend_cents FROM seasons")
def q_unnest(t: Tables):
    return history_unnest(snapshots(t, LAST, static=[]).filter(F.col("year") == LAST), KEYS)


@query(
    "first_to_last_ratio",
    f"""WITH {SNAPSHOTS},
    ends AS (SELECT customer_id, arg_max(spend_cents, year) AS z, arg_min(spend_cents, year) AS a FROM seasons GROUP BY customer_id)
    SELECT customer_id, CAST(z AS DOUBLE) / CASE WHEN a = 0 THEN 1.0 ELSE CAST(a AS DOUBLE) END AS ratio
    FROM ends JOIN snapshots USING (customer_id) WHERE year = 2001 AND grade = 'star'""",
)
def q_ratio(t: Tables):
    return first_to_last_ratio(snapshots(t, LAST, static=[]), KEYS, "spend_cents", "year", LAST, grades=["star"])


SCD_NAMES = {"start": "start_year", "end": "end_year", "current": "current_year"}


@query("scd2_backfill", f"WITH {SNAPSHOTS}, {RUNS.format(upto=2000)}")
def q_scd_backfill(t: Tables):
    return scd2_backfill(snapshots(t, LAST - 1, static=[]), KEYS, "year", ATTRS, LAST - 1, **SCD_NAMES)


@query("scd2_step", f"WITH {SNAPSHOTS}, {RUNS.format(upto=2001)}")
def q_scd_step(t: Tables):
    all_years = snapshots(t, LAST, static=[])
    scd = scd2_backfill(all_years, KEYS, "year", ATTRS, LAST - 1, **SCD_NAMES)
    return scd2_step(scd, all_years, KEYS, "year", ATTRS, LAST, **SCD_NAMES)


STATES = f"""{SEASONS},
{GRID},
presence AS (
  SELECT g.customer_id, g.year, s.year IS NOT NULL AS here,
         lag(s.year IS NOT NULL) OVER (PARTITION BY g.customer_id ORDER BY g.year) AS was_here
  FROM grid g LEFT JOIN seasons s ON s.customer_id = g.customer_id AND s.year = g.year),
states AS (
  SELECT customer_id, year,
         CASE WHEN was_here IS NULL THEN 'New' WHEN here AND was_here THEN 'Continued Playing'
              WHEN here THEN 'Returned from Retirement' WHEN was_here THEN 'Retired'
              ELSE 'Stayed Retired' END AS player_status
  FROM presence)"""


@query("state_track_backfill", f"WITH {STATES} SELECT * FROM states")
def q_states(t: Tables):
    return state_track_backfill(t.seasons(), KEYS, "year", FIRST, LAST)


@query("state_track_step", f"WITH {STATES} SELECT * FROM states WHERE year = 2001")
def q_state_step(t: Tables):
    facts = t.seasons()
    prev = state_track_backfill(facts, KEYS, "year", FIRST, LAST - 1).filter(F.col("year") == LAST - 1)
    return state_track_step(prev, facts.filter(F.col("year") == LAST), KEYS, "year")
