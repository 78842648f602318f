"""Product metrics and table checks, mostly on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.operators.metrics import (
    actions_per_user,
    active_users,
    churn,
    completion_rate,
    experiment_cells,
    net_promoter_score,
    rate_between,
    retention,
    sessions_per_week,
)
from tallyglass.operators.quality import (
    cardinality,
    cardinality_closeness,
    completeness,
    completeness_by_hour,
    daily_by_zone,
    duplicate_keys,
    fast_users,
    freshness,
    layout_sizes,
    malformed_split,
    unknown_names,
    without_fast_users,
)
from tallyglass.operators.sessions import week_of
from tallyglass.plans.registry import query
from tallyglass.plans.session_queries import SIX_HOURS, sessions_sql
from tallyglass.sources.bindings import Tables

AS_OF = "2024-01-30"
ACTIONS = ["view", "click", "purchase", "signup"]


def day():
    return F.to_date("ts")


@query(
    "sessions_per_user_week",
    f"""WITH {sessions_sql(SIX_HOURS, 'user_id')}
    SELECT user_id, CAST(date_trunc('week', session_start) AS DATE) AS week, count(*) AS session_count,
           CAST(sum(epoch_us(session_last) - epoch_us(session_start)) AS DOUBLE) / 1e6 AS seconds_spent
    FROM sessions GROUP BY ALL""",
)
def q_sessions_week(t: Tables):
    return sessions_per_week(t.events, "user_id", "ts", SIX_HOURS)


@query(
    "actions_per_user",
    "SELECT user_id, "
    + ", ".join(f"count(*) FILTER (WHERE event_type = '{a}') AS {a}_count" for a in ACTIONS)
    + " FROM events GROUP BY user_id",
)
def q_actions(t: Tables):
    return actions_per_user(t.events, "user_id", "event_type", ACTIONS)


def rate_sql(reached: str, base: str) -> str:
    return f"""WITH users AS (
      SELECT CAST(date_trunc('week', ts) AS DATE) AS week,
             count(DISTINCT CASE WHEN event_type = '{base}' THEN user_id END) AS base_users,
             count(DISTINCT CASE WHEN event_type = '{reached}' THEN user_id END) AS reached_users
      FROM events WHERE event_type IN ('{base}', '{reached}') GROUP BY week)
    SELECT *, CASE WHEN base_users <> 0 THEN CAST(reached_users AS DOUBLE) / base_users END AS rate FROM users"""


def weekly_rate(t: Tables, reached: str, base: str):
    kind = F.col("event_type")
    return rate_between(t.events, [week_of("ts").alias("week")], "user_id", kind == reached, kind == base)


@query("click_through_rate", rate_sql("click", "view"))
def q_clicks(t: Tables):
    return weekly_rate(t, "click", "view")


@query("conversion_rate", rate_sql("purchase", "view"))
def q_conversion(t: Tables):
    return weekly_rate(t, "purchase", "view")


@query(
    "purchase_share",
    """WITH users AS (
      SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(DISTINCT user_id) AS base_users,
             count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS reached_users
      FROM events GROUP BY week)
    SELECT *, CASE WHEN base_users <> 0 THEN CAST(reached_users AS DOUBLE) / base_users END AS rate FROM users""",
)
def q_purchase_share(t: Tables):
    """Buyers among all users: every event meets the base condition, purchases meet both."""
    return rate_between(t.events, [week_of("ts").alias("week")], "user_id", F.col("event_type") == "purchase", F.lit(True))


@query(
    "retention",
    f"""WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
    firsts AS (SELECT user_id, min(day) AS cohort_day FROM days GROUP BY user_id),
    ages AS (SELECT f.user_id, f.cohort_day, date_diff('day', f.cohort_day, d.day) AS age FROM firsts f JOIN days d USING (user_id)),
    per_user AS (SELECT user_id, cohort_day, bool_or(age BETWEEN 1 AND 7) AS r7, bool_or(age BETWEEN 1 AND 30) AS r30 FROM ages GROUP BY ALL)
    SELECT cohort_day, count(*) AS cohort_users,
           CASE WHEN date_diff('day', cohort_day, DATE '{AS_OF}') >= 7 THEN count(*) FILTER (WHERE r7) END AS retained_7d,
           CASE WHEN date_diff('day', cohort_day, DATE '{AS_OF}') >= 30 THEN count(*) FILTER (WHERE r30) END AS retained_30d
    FROM per_user GROUP BY cohort_day""",
)
def q_retention(t: Tables):
    return retention(t.events, "user_id", day(), [7, 30], AS_OF)


@query(
    "churn",
    f"""WITH seen AS (SELECT user_id, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS z FROM events GROUP BY user_id)
    SELECT count(*) AS known_users, count(*) FILTER (WHERE z <= DATE '{AS_OF}' - 2) AS churned_users
    FROM seen WHERE a <= DATE '{AS_OF}' - 2""",
)
def q_churn(t: Tables):
    return churn(t.events, "user_id", day(), 2, AS_OF)


@query(
    "active_users",
    f"""WITH ages AS (SELECT DISTINCT user_id, date_diff('day', CAST(ts AS DATE), DATE '{AS_OF}') AS age FROM events)
    SELECT count(DISTINCT user_id) FILTER (WHERE age = 0) AS daily_active_users,
           count(DISTINCT user_id) FILTER (WHERE age BETWEEN 0 AND 6) AS weekly_active_users,
           count(DISTINCT user_id) FILTER (WHERE age BETWEEN 0 AND 31) AS monthly_active_users FROM ages""",
)
def q_active(t: Tables):
    return active_users(t.events, "user_id", day(), AS_OF)


@query(
    "completion_rate",
    """SELECT l_returnflag, count(*) AS row_count, CAST(sum(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) AS BIGINT) AS completed,
       avg(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) AS completion_rate FROM lineitem GROUP BY l_returnflag""",
)
def q_completion(t: Tables):
    return completion_rate(t.lineitem, ["l_returnflag"], F.col("l_quantity"), F.lit(50.0))


@query(
    "net_promoter_score",
    """WITH rated AS (SELECT event_type, CAST(floor(value) AS BIGINT) % 11 AS score FROM events WHERE CAST(floor(value) AS BIGINT) % 11 BETWEEN 0 AND 10),
    counted AS (SELECT event_type, count(*) AS answers, count(*) FILTER (WHERE score >= 9) AS promoters,
                count(*) FILTER (WHERE score <= 6) AS detractors FROM rated GROUP BY event_type)
    SELECT *, CAST(promoters - detractors AS DOUBLE) * 100 / answers AS net_promoter_score FROM counted""",
)
def q_nps(t: Tables):
    return net_promoter_score(t.events, ["event_type"], F.floor("value") % 11)


CELLS = {"control": 33, "every_two_days": 33, "daily": 34}


@query(
    "experiment_cells",
    """WITH users AS (SELECT DISTINCT user_id FROM events),
    placed AS (SELECT user_id, CAST('0x' || substr(md5('weekly_mix:' || user_id), 1, 8) AS BIGINT) % 100 AS percent FROM users)
    SELECT user_id, CASE WHEN percent < 33 THEN 'control' WHEN percent < 66 THEN 'every_two_days' ELSE 'daily' END AS cell FROM placed""",
)
def q_cells(t: Tables):
    return experiment_cells(t.events.select("user_id").distinct(), "user_id", "weekly_mix", CELLS)


def completeness_sql(key: str, unit: str, trailing: int, at_least: float, name: str, kind: str) -> str:
    """Counts of every calendar step of a key, from its first to the newest of all."""
    return f"""WITH counts AS (SELECT {key}, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS slot, count(*) AS n FROM events GROUP BY ALL),
    firsts AS (SELECT {key}, min(slot) AS debut FROM counts GROUP BY {key}),
    steps AS (SELECT unnest(generate_series((SELECT min(slot) FROM counts), (SELECT max(slot) FROM counts), INTERVAL 1 {unit})) AS slot),
    calendar AS (SELECT f.{key}, s.slot FROM firsts f JOIN steps s ON s.slot >= f.debut),
    filled AS (SELECT c.{key}, c.slot, coalesce(n, 0) AS row_count FROM calendar c LEFT JOIN counts USING ({key}, slot)),
    means AS (SELECT *, avg(row_count) OVER (PARTITION BY {key} ORDER BY slot ROWS BETWEEN {trailing} PRECEDING AND 1 PRECEDING) AS trailing_mean FROM filled)
    SELECT {key}, CAST(slot AS {kind}) AS {name}, row_count, trailing_mean, coalesce(row_count < trailing_mean * {at_least}, false) AS is_low FROM means"""


@query("completeness_check", completeness_sql("event_type", "day", 7, 0.9, "day", "DATE"))
def q_completeness(t: Tables):
    return completeness(t.events, ["event_type"], day(), trailing=7, at_least=0.9)


@query("completeness_by_hour", completeness_sql("user_id", "hour", 24, 0.5, "hour", "TIMESTAMP"))
def q_completeness_hour(t: Tables):
    newest = t.events.agg(F.max("ts")).first()[0]
    hourly = completeness_by_hour(t.events, ["user_id"], "ts", newest)
    return hourly.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(
    "freshness_check",
    f"""SELECT event_type, max(ts) AS newest, CAST(date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') AS INTEGER) AS age_days,
        date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') > 1 AS is_stale FROM events GROUP BY event_type""",
)
def q_freshness(t: Tables):
    return freshness(t.events, ["event_type"], "ts", "2024-02-01")


MALFORMED = """WITH marked AS (
  SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events)"""


def split_events(t: Tables):
    rules = {"k_range": F.col("record_value.k") < 95, "no_value": F.col("value").isNotNull()}
    return malformed_split(t.events.select("event_id", "value", "props"), "props", "k int", rules)


@query("malformed_good_rows", f"{MALFORMED} SELECT event_id, k FROM marked WHERE k < 95 AND value IS NOT NULL")
def q_good(t: Tables):
    return split_events(t)[0].select("event_id", "record_value.k")


@query(
    "malformed_bad_rows",
    f"""{MALFORMED} SELECT event_id, CASE WHEN k < 95 THEN 'no_value' ELSE 'k_range' END AS reason
    FROM marked WHERE NOT (k < 95 AND value IS NOT NULL)""",
)
def q_bad(t: Tables):
    return split_events(t)[1].select("event_id", "reason")


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def q_duplicates(t: Tables):
    return duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


RATES = """rates AS (SELECT user_id, date_trunc('day', ts) AS unit, count(*) AS n FROM events GROUP BY ALL),
fast AS (SELECT user_id, max(n) AS max_rate FROM rates GROUP BY user_id HAVING max(n) > 7)"""


@query("fast_users", f"WITH {RATES} SELECT * FROM fast")
def q_fast(t: Tables):
    return fast_users(t.events, "user_id", "ts", "day", 7)


@query(
    "without_fast_users",
    f"WITH {RATES} SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM fast)",
)
def q_without_fast(t: Tables):
    return without_fast_users(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", "day", 7).drop("ts")


@query(
    "unknown_event_names",
    "SELECT event_type, count(*) AS row_count FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY event_type",
)
def q_unknown(t: Tables):
    return unknown_names(t.events, "event_type", ["view", "click", "purchase"])


@query(
    "cardinality_check",
    """SELECT 'event_type' AS column_name, count(DISTINCT event_type) AS distinct_values, count(DISTINCT event_type) > 100 AS is_high FROM events
    UNION ALL SELECT 'user_id', count(DISTINCT user_id), count(DISTINCT user_id) > 100 FROM events""",
)
def q_cardinality(t: Tables):
    return cardinality(t.events, ["event_type", "user_id"], 100, exact=True)


@query(
    "cardinality_check_approx",
    """SELECT 'event_type' AS column_name, count(DISTINCT event_type) > 100 AS is_high, true AS is_close FROM events
    UNION ALL SELECT 'user_id', count(DISTINCT user_id) > 100, true FROM events""",
)
def q_cardinality_approx(t: Tables):
    return cardinality_closeness(t.events, ["event_type", "user_id"], 100)


@query(
    "daily_by_zone",
    """SELECT 'UTC' AS zone, CAST(ts AS DATE) AS day, count(*) AS row_count FROM events GROUP BY ALL
    UNION ALL SELECT 'Asia/Kolkata', CAST(ts + INTERVAL 330 MINUTE AS DATE), count(*) FROM events GROUP BY ALL""",
)
def q_zone(t: Tables):
    return daily_by_zone(t.events, "ts", "Asia/Kolkata")


LAYOUTS = {
    "as_read": ([], []),
    "by_order": (["l_orderkey"], ["l_orderkey"]),
    "by_part": (["l_partkey"], ["l_partkey", "l_suppkey"]),
}


@query("layout_sizes", " UNION ALL ".join(f"SELECT '{n}' AS layout, CAST(16 AS BIGINT) AS files, count(*) AS row_count FROM lineitem" for n in LAYOUTS))
def q_layouts(t: Tables):
    """Rows and files per layout; the sizes in bytes, which SQL cannot know, are left to the operator's callers."""
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"]
    return layout_sizes(t.lineitem.select(*columns), LAYOUTS, 16).drop("bytes")
