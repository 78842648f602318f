"""Deduplication, activity lists, monthly arrays and profiles, on events and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.operators.datelist import (
    activity_datelist_step,
    datelist_backfill,
    datelist_int,
    datelist_int_from_events,
    host_datelist_step,
)
from tallyglass.operators.dedup import dedup_keep_one, device_days, device_event_join, distinct_on
from tallyglass.operators.monthly import (
    daily_measures,
    monthly_array_backfill,
    monthly_array_rollup,
    monthly_array_step,
)
from tallyglass.operators.profile import (
    count_by,
    date_range,
    joined_duplicates,
    length_histogram,
    rows_with_key_count,
)
from tallyglass.plans.registry import query
from tallyglass.sources.bindings import Tables

YESTERDAY, TODAY = "2024-01-29", "2024-01-30"

GAME_ORDER = [
    "player_id", "team_id", "pts", "start_position", "line_status", "game_date", "price_cents", "discount_cents",
    "tax_cents",
]

GAME_DETAILS = """game_details AS (
  SELECT l_orderkey AS game_id, l_linenumber AS line_id, l_partkey AS player_id, l_suppkey AS team_id,
         CAST(l_quantity AS BIGINT) AS pts, l_returnflag AS start_position, l_linestatus AS line_status,
         CAST(l_shipdate AS DATE) AS game_date, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents,
         CAST(round(l_discount * 100) AS BIGINT) AS discount_cents, CAST(round(l_tax * 100) AS BIGINT) AS tax_cents
  FROM lineitem)"""
UNIQUE_DETAILS = f"""{GAME_DETAILS},
unique_details AS (
  SELECT * EXCLUDE (rank_no) FROM (
    SELECT *, row_number() OVER (PARTITION BY game_id, line_id ORDER BY player_id, team_id, pts, start_position,
             line_status, game_date, price_cents, discount_cents, tax_cents) AS rank_no
    FROM game_details) WHERE rank_no = 1)"""
WEB = """web AS (
  SELECT event_id, user_id, user_id * 100 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS device_id,
         event_type AS host, ts AS event_time, CAST(ts AS DATE) AS day
  FROM events)"""
DEVICES = """devices AS (
  SELECT DISTINCT device_id, 'browser' || (device_id % 5) AS browser_type, 'os' || (device_id % 3) AS os_type FROM web)"""


def unique_details(t: Tables):
    return dedup_keep_one(t.game_details(), ["game_id", "line_id"], GAME_ORDER)


def as_text(df, column: str):
    """Array as text, so both engines compare the same values."""
    return df.withColumn(column, F.array_join(F.col(column).cast("array<string>"), ","))


def event_day():
    return F.to_date("event_time")


@query("dedup_keep_one", f"WITH {UNIQUE_DETAILS} SELECT * FROM unique_details")
def q_dedup(t: Tables):
    return unique_details(t)


@query(
    "dedup_events",
    f"WITH {WEB} SELECT DISTINCT user_id, device_id, host, event_time FROM web",
)
def q_dedup_events(t: Tables):
    return distinct_on(t.web_events_with_copies(), ["user_id", "device_id", "host", "event_time"])


@query(
    "dedup_devices",
    f"WITH {WEB}, {DEVICES} SELECT * FROM devices",
)
def q_dedup_devices(t: Tables):
    return dedup_keep_one(t.devices(), ["device_id", "browser_type", "os_type"], ["device_id"])


@query(
    "device_event_join",
    f"""WITH {WEB}, {DEVICES}
    SELECT DISTINCT d.*, w.user_id, w.host, w.event_time FROM devices d JOIN web w USING (device_id)
    WHERE w.user_id IS NOT NULL""",
)
def q_device_join(t: Tables):
    return device_event_join(t.devices(), t.web_events_with_copies())


@query(
    "device_event_join_all_devices",
    f"""WITH {WEB}, {DEVICES},
    every AS (SELECT * FROM devices UNION SELECT c_custkey * 100 + 99, 'browser' || (c_custkey * 100 + 99) % 5, 'os' || (c_custkey * 100 + 99) % 3 FROM customer),
    seen AS (SELECT DISTINCT user_id, device_id, host, event_time FROM web)
    SELECT d.*, s.user_id, s.host, s.event_time FROM every d LEFT JOIN seen s USING (device_id)""",
)
def q_device_join_all(t: Tables):
    """Over all events; every customer has a registered device, of which many are silent."""
    number = F.col("c_custkey") * 100 + 99
    registered = t.customer.select(
        number.alias("device_id"),
        F.concat(F.lit("browser"), (number % 5).cast("string")).alias("browser_type"),
        F.concat(F.lit("os"), (number % 3).cast("string")).alias("os_type"),
    )
    return device_event_join(t.devices().unionByName(registered), t.web_events_with_copies(), how="left")


USER_KEYS = ["user_id", "device_id", "browser_type"]
USER_DAYS = f"""{WEB}, {DEVICES},
user_days AS (
  SELECT DISTINCT w.user_id, w.device_id, d.browser_type, w.day FROM web w JOIN devices d USING (device_id)
  WHERE w.user_id IS NOT NULL AND w.day <= DATE '2024-01-30')"""


def user_days(t: Tables):
    return device_days(t.devices(), t.web_events(), USER_KEYS)


def user_datelists(t: Tables, at: str, dates: str = "device_activity_datelist"):
    return datelist_backfill(user_days(t), USER_KEYS, F.col("active_date"), at, dates, newest_first=True)


@query(
    "activity_datelist_step",
    f"""WITH {USER_DAYS}
    SELECT user_id, device_id, browser_type, DATE '2024-01-30' AS date,
           string_agg(CAST(day AS VARCHAR), ',' ORDER BY day DESC) AS device_activity_datelist
    FROM user_days GROUP BY user_id, device_id, browser_type""",
)
def q_activity_step(t: Tables):
    snapshot = activity_datelist_step(user_datelists(t, YESTERDAY), user_days(t), USER_KEYS, TODAY)
    return as_text(snapshot, "device_activity_datelist")


@query(
    "host_datelist_step",
    f"""WITH {WEB}
    SELECT host, DATE '2024-01-30' AS date, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) AS host_activity_datelist
    FROM (SELECT DISTINCT host, day FROM web WHERE day <= DATE '2024-01-30') GROUP BY host""",
)
def q_host_step(t: Tables):
    events = t.web_events()
    prev = datelist_backfill(events, ["host"], event_day(), YESTERDAY, "host_activity_datelist", newest_first=False)
    today = events.select("host", event_day().alias("active_date"))
    return as_text(host_datelist_step(prev, today, ["host"], TODAY), "host_activity_datelist")


def bits_sql(keys: str, source: str, top: int) -> str:
    return f"""bits AS (
  SELECT {keys}, CAST(sum(CASE WHEN {top} - date_diff('day', day, DATE '2024-01-30') BETWEEN 0 AND 31
             THEN CAST(1 AS BIGINT) << CAST({top} - date_diff('day', day, DATE '2024-01-30') AS BIGINT) ELSE 0 END) AS BIGINT) AS datelist_int
  FROM {source} GROUP BY {keys})
SELECT *, datelist_int <> 0 AS dim_is_monthly_active, (datelist_int & 4261412864) <> 0 AS dim_is_weekly_active,
       (datelist_int & 2147483648) <> 0 AS dim_is_daily_active FROM bits"""


@query("datelist_int", f"WITH {USER_DAYS}, {bits_sql('user_id, device_id, browser_type', 'user_days', 31)}")
def q_datelist_int(t: Tables):
    return datelist_int(user_datelists(t, TODAY), USER_KEYS, "device_activity_datelist", TODAY)


@query("datelist_int_day_after", f"WITH {USER_DAYS}, {bits_sql('user_id, device_id, browser_type', 'user_days', 32)}")
def q_datelist_int_lagged(t: Tables):
    return datelist_int(user_datelists(t, TODAY), USER_KEYS, "device_activity_datelist", TODAY, top_bit_age=1)


@query(
    "datelist_int_from_events",
    f"WITH {WEB}, days AS (SELECT DISTINCT user_id, day FROM web), {bits_sql('user_id', 'days', 31)}",
)
def q_datelist_bits(t: Tables):
    return datelist_int_from_events(t.web_events(), ["user_id"], event_day(), TODAY)


USER_METRICS = f"""WITH {WEB},
days AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day),
counts AS (SELECT user_id, day, count(*) AS hits FROM web GROUP BY user_id, day),
metrics AS (
  SELECT u.user_id, 'site_hits' AS metric_name, DATE '2024-01-01' AS month_start, d.day, coalesce(c.hits, 0) AS hits
  FROM (SELECT DISTINCT user_id FROM web WHERE day <= DATE '2024-01-30') u CROSS JOIN days d
  LEFT JOIN counts c ON c.user_id = u.user_id AND c.day = d.day)"""
METRIC_KEYS = ["user_id", "metric_name"]


def metric_events(t: Tables):
    return t.web_events().filter(F.col("user_id").isNotNull()).withColumn("metric_name", F.lit("site_hits"))


def user_arrays(t: Tables, at: str):
    measures = {"hits": (F.count(F.lit(1)), "metric_array")}
    return monthly_array_backfill(metric_events(t), METRIC_KEYS, event_day(), at, measures)


@query(
    "monthly_array_step",
    f"""{USER_METRICS}
    SELECT user_id, metric_name, month_start, string_agg(CAST(hits AS VARCHAR), ',' ORDER BY day) AS metric_array
    FROM metrics GROUP BY user_id, metric_name, month_start""",
)
def q_monthly(t: Tables):
    daily = daily_measures(metric_events(t), METRIC_KEYS, event_day(), TODAY, {"hits": F.count(F.lit(1))})
    month = monthly_array_step(user_arrays(t, YESTERDAY), daily, METRIC_KEYS, TODAY, {"hits": "metric_array"})
    return as_text(month, "metric_array")


@query(
    "monthly_array_step_hosts",
    f"""WITH {WEB},
    per_day AS (SELECT host, day, count(*) AS hits, count(DISTINCT user_id) AS visitors FROM web GROUP BY host, day),
    days AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day),
    grid AS (SELECT h.host, d.day, coalesce(p.hits, 0) AS hits, coalesce(p.visitors, 0) AS visitors
             FROM (SELECT DISTINCT host FROM web) h CROSS JOIN days d LEFT JOIN per_day p ON p.host = h.host AND p.day = d.day)
    SELECT host, DATE '2024-01-01' AS month_start, string_agg(CAST(hits AS VARCHAR), ',' ORDER BY day) AS hit_array,
           string_agg(CAST(visitors AS VARCHAR), ',' ORDER BY day) AS unique_visitors
    FROM grid GROUP BY host""",
)
def q_monthly_hosts(t: Tables):
    events = t.web_events()
    hits, visitors = F.count(F.lit(1)), F.count_distinct("user_id")
    prev = monthly_array_backfill(
        events, ["host"], event_day(), YESTERDAY, {"hits": (hits, "hit_array"), "visitors": (visitors, "unique_visitors")}
    )
    daily = daily_measures(events, ["host"], event_day(), TODAY, {"hits": hits, "visitors": visitors})
    month = monthly_array_step(prev, daily, ["host"], TODAY, {"hits": "hit_array", "visitors": "unique_visitors"})
    return as_text(as_text(month, "hit_array"), "unique_visitors")


@query(
    "monthly_array_rollup",
    f"""{USER_METRICS}
    SELECT metric_name, day AS date, CAST(sum(hits) AS BIGINT) AS value FROM metrics GROUP BY metric_name, day""",
)
def q_rollup(t: Tables):
    return monthly_array_rollup(user_arrays(t, TODAY), ["metric_name"], "metric_array")


@query(
    "profile_date_range",
    "SELECT CAST(min(ts) AS DATE) AS first_date, CAST(max(ts) AS DATE) AS last_date FROM events",
)
def q_range(t: Tables):
    return date_range(t.events, "ts")


@query(
    "profile_device_counts",
    f"""WITH {WEB}
    SELECT device_id, 'browser' || (device_id % 5) AS browser_type, 'os' || (device_id % 3) AS os_type, count(*) AS row_count
    FROM web GROUP BY ALL""",
)
def q_device_counts(t: Tables):
    return count_by(t.devices(), ["device_id", "browser_type", "os_type"])


@query(
    "profile_keys_seen_twice",
    f"""WITH {WEB}
    SELECT event_id, user_id, device_id, host, event_time FROM web
    WHERE device_id IN (SELECT device_id FROM web GROUP BY device_id HAVING count(*) = 2)""",
)
def q_twice(t: Tables):
    return rows_with_key_count(t.web_events(), ["device_id"], 2)


@query("profile_host_counts", "SELECT event_type AS host, count(*) AS row_count FROM events GROUP BY event_type")
def q_host_counts(t: Tables):
    return count_by(t.web_events(), ["host"], sort=False)


@query(
    "profile_array_lengths",
    f"""WITH {USER_DAYS}
    SELECT array_length, count(*) AS row_count FROM (
      SELECT CAST(count(*) AS INTEGER) AS array_length FROM user_days GROUP BY user_id, device_id, browser_type) GROUP BY array_length""",
)
def q_lengths(t: Tables):
    return length_histogram(user_datelists(t, TODAY), "device_activity_datelist")


@query(
    "profile_joined_duplicates",
    f"""WITH {WEB}, {DEVICES},
    raw AS (SELECT * FROM web UNION ALL SELECT * FROM web WHERE host = 'error')
    SELECT r.user_id, d.device_id, d.browser_type, r.event_time, count(*) AS cnt
    FROM devices d JOIN raw r USING (device_id) WHERE r.user_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""",
)
def q_joined_duplicates(t: Tables):
    unique = distinct_on(t.devices(), ["device_id", "browser_type", "os_type"])
    joined = unique.join(t.web_events_with_copies(), "device_id")
    return joined_duplicates(joined, ["user_id", "device_id", "browser_type", "event_time"], minimum=2)
