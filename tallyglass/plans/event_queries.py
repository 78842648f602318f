"""Order, rates and series of events: funnels, sliding rates, active users of every day, drift of records, intervals, layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.operators.funnel import ordered_funnel
from tallyglass.operators.layouts import layout_skipping, z_value
from tallyglass.operators.metrics import active_users_by_day, active_users_series, daily_user_bitmaps
from tallyglass.operators.quality import fast_users_sliding, record_drift, without_fast_users_sliding
from tallyglass.operators.ranges import interval_join
from tallyglass.operators.sessions import week_of
from tallyglass.plans.registry import query
from tallyglass.sources.bindings import Tables

DAY = 86_400


def day():
    return F.to_date("ts")


def funnel_sql(steps: list[str], seconds: int) -> str:
    """Users per week of the first step by the furthest step, found by joining each step to later ones."""
    tables = [f"s{i} AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = '{s}')" for i, s in enumerate(steps)]
    joins = " ".join(
        f"LEFT JOIN s{i} ON s{i}.user_id = s{i - 1}.user_id AND s{i}.ts > s{i - 1}.ts AND s{i}.ts <= s{i - 1}.ts + INTERVAL {seconds} SECOND"
        for i in range(1, len(steps))
    )
    depth = " ".join(f"WHEN s{i}.ts IS NOT NULL THEN {i + 1}" for i in reversed(range(1, len(steps))))
    counts = ", ".join(f"count(*) FILTER (WHERE depth > {i}) AS {s}_users" for i, s in enumerate(steps))
    return f"""WITH {', '.join(tables)},
    furthest AS (SELECT s0.user_id, CAST(date_trunc('week', s0.ts) AS DATE) AS week, max(CASE {depth} ELSE 1 END) AS depth
                 FROM s0 {joins} GROUP BY ALL),
    counted AS (SELECT week, {counts} FROM furthest GROUP BY week)
    SELECT *, CAST({steps[-1]}_users AS DOUBLE) / {steps[0]}_users AS rate FROM counted"""


def weekly_funnel(t: Tables, steps: list[str], seconds: int):
    kinds = {s: F.col("event_type") == s for s in steps}
    return ordered_funnel(t.events, "user_id", "ts", kinds, seconds, week_of("ts")).withColumnRenamed("period", "week")


@query("ordered_funnel", funnel_sql(["view", "click", "purchase"], 3 * DAY))
def q_funnel(t: Tables):
    """Viewers, those who click within three days of a view, and those who buy within three days of that click."""
    return weekly_funnel(t, ["view", "click", "purchase"], 3 * DAY)


@query("ordered_conversion", funnel_sql(["click", "purchase"], 7 * DAY))
def q_ordered_conversion(t: Tables):
    return weekly_funnel(t, ["click", "purchase"], 7 * DAY)


SLIDING = f"""rates AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts
  RANGE BETWEEN INTERVAL {DAY * 1_000_000 - 1} MICROSECOND PRECEDING AND CURRENT ROW) AS n FROM events),
fast AS (SELECT user_id, max(n) AS max_rate FROM rates GROUP BY user_id HAVING max(n) > 7)"""


@query("fast_users_sliding", f"WITH {SLIDING} SELECT user_id, CAST(max_rate AS BIGINT) AS max_rate FROM fast")
def q_fast_sliding(t: Tables):
    """Users with more than seven events in any 24 hours."""
    return fast_users_sliding(t.events, "user_id", "ts", DAY, 7)


@query("without_fast_users_sliding", f"WITH {SLIDING} SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM fast)")
def q_without_fast_sliding(t: Tables):
    return without_fast_users_sliding(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", DAY, 7).drop("ts")


SERIES = {"daily_active_users": 1, "weekly_active_users": 7, "monthly_active_users": 30}
SERIES_SQL = f"""WITH seen AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS seen_day FROM events),
days AS (SELECT CAST(unnest(generate_series((SELECT min(seen_day) FROM seen), (SELECT max(seen_day) FROM seen), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, {', '.join(f'count(DISTINCT user_id) FILTER (WHERE seen_day > day - {n}) AS {name}' for name, n in SERIES.items())}
FROM days LEFT JOIN seen ON seen_day <= day AND seen_day > day - 30 GROUP BY day"""


@query("active_users_series", SERIES_SQL)
def q_series(t: Tables):
    """Daily, weekly and monthly active users of every day, from one bitmap per day and bucket of users."""
    return active_users_series(daily_user_bitmaps(t.events, "user_id", day()), SERIES)


@query("active_users_by_day", SERIES_SQL)
def q_by_day(t: Tables):
    """The same from the edges of each user's stretches, for users that have no small numbers."""
    return active_users_by_day(t.events.withColumn("name", F.concat(F.lit("u"), "user_id")), "name", day(), SERIES)


def drift_sql(records: str) -> str:
    """Types per day and field by DuckDB's own JSON types, in Spark's words, against the first day."""
    return f"""WITH records AS ({records}),
    keyed AS (SELECT day, record, unnest(json_keys(record)) AS field FROM records),
    typed AS (SELECT day, field, json_type(record, '$.' || field) AS kind FROM keyed),
    named AS (SELECT day, field, CASE WHEN kind IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' WHEN kind = 'DOUBLE' THEN 'DECIMAL'
              WHEN kind = 'VARCHAR' THEN 'STRING' ELSE kind END AS kind FROM typed),
    found AS (SELECT day, field, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind)
              WHEN bool_and(kind IN ('BIGINT', 'DECIMAL')) THEN 'DECIMAL' ELSE 'VARIANT' END AS type, count(*) AS row_count
              FROM named GROUP BY day, field),
    days AS (SELECT DISTINCT day FROM records),
    base AS (SELECT field, type AS base_type FROM found WHERE day = (SELECT min(day) FROM days)),
    wanted AS (SELECT day, field, base_type FROM days, base)
    SELECT day, field, base_type, type AS found_type, CASE WHEN base_type IS NULL THEN 'added' WHEN type IS NULL THEN 'missing'
           WHEN base_type <> type THEN 'type' END AS drift, coalesce(row_count, 0) AS row_count
    FROM wanted FULL JOIN found USING (day, field)"""


@query("record_drift", drift_sql("SELECT CAST(ts AS DATE) AS day, CAST(props AS JSON) AS record FROM events"))
def q_drift(t: Tables):
    """The events' own records, day by day against the first."""
    return record_drift(t.events, day(), "props")


CHANGED = "event_type = 'error' AND ts >= TIMESTAMP '2024-01-10'"


@query(
    "record_drift_changed",
    drift_sql(
        f"""SELECT CAST(ts AS DATE) AS day, CAST(CASE
        WHEN ts >= TIMESTAMP '2024-01-20' THEN '{{"kind":"' || event_type || '","user":' || user_id || '}}'
        WHEN {CHANGED} THEN '{{"kind":"' || event_type || '","value":"' || user_id || '","retry":true}}'
        ELSE '{{"kind":"' || event_type || '","value":' || user_id || '}}' END AS JSON) AS record FROM events"""
    ),
)
def q_drift_changed(t: Tables):
    """Records built from the events: a field of two types and a new one from the tenth on, one gone from the twentieth on."""
    kind, user = F.concat(F.lit('{"kind":"'), "event_type", F.lit('"')), F.col("user_id").cast("string")
    record = (
        F.when(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"), F.concat(kind, F.lit(',"user":'), user, F.lit("}")))
        .when(F.expr(CHANGED), F.concat(kind, F.lit(',"value":"'), user, F.lit('","retry":true}')))
        .otherwise(F.concat(kind, F.lit(',"value":'), user, F.lit("}")))
    )
    return record_drift(t.events.select("ts", record.alias("record")), day(), "record")


@query(
    "interval_join",
    """SELECT p.event_id, count(*) AS errors FROM events p JOIN events e ON e.event_type = 'error' AND p.event_type = 'purchase'
    AND p.ts <= e.ts AND e.ts < p.ts + INTERVAL 1 HOUR GROUP BY p.event_id""",
)
def q_interval(t: Tables):
    """Errors of anyone in the hour after each purchase."""
    hour = 3_600_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    errors = t.events.filter("event_type = 'error'").select(at.alias("error_at"))
    hours = t.events.filter("event_type = 'purchase'").select("event_id", at.alias("start_at"), (at + hour).alias("end_at"))
    pairs = interval_join(errors, hours, "error_at", "start_at", "end_at", hour)
    return pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("errors"))


@query(
    "debut_grid",
    """WITH debuts AS (SELECT o_custkey AS customer_id, min(year(o_orderdate)) AS debut FROM orders GROUP BY 1),
    years AS (SELECT DISTINCT year(o_orderdate) AS year FROM orders)
    SELECT year, count(*) AS customers FROM years JOIN debuts ON debut <= year GROUP BY year""",
)
def q_debut_grid(t: Tables):
    """Customers that had their debut by each year: a join on an inequality alone."""
    years = t.orders.select(F.year("o_orderdate").alias("year")).distinct()
    debuts = t.orders.groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("debut"))
    pairs = interval_join(years, debuts, "year", "debut", None, 1)
    return pairs.groupBy("year").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "layout_skipping",
    """WITH total AS (SELECT count(*) > 0 AS filled FROM lineitem)
    SELECT layout, column_name, CAST(16 AS BIGINT) AS files, prunes AND filled AS prunes FROM total, (VALUES
      ('as_read', 'l_partkey', false), ('as_read', 'l_orderkey', false), ('linear', 'l_partkey', true), ('linear', 'l_orderkey', false),
      ('z_order', 'l_partkey', true), ('z_order', 'l_orderkey', true)) AS expected (layout, column_name, prunes)""",
)
def q_skipping(t: Tables):
    """Whether a filter on a fiftieth of a column's values can leave out half of a layout's files, by their least and largest values.

    A linear order prunes on its first column alone, Z-order on both.  The numbers of files are the operator's to give.
    """
    items = t.lineitem.select("l_partkey", "l_orderkey", "l_quantity")
    columns = ["l_partkey", "l_orderkey"]
    ends = items.agg(*[f(c) for c in columns for f in (F.min, F.max)]).first()
    wanted = {c: (low + (high - low) * 0.3, low + (high - low) * 0.32) for c, low, high in zip(columns, ends[::2], ends[1::2], strict=True)}
    layouts = {"as_read": [], "linear": columns, "z_order": [z_value(items, columns)]}
    report = layout_skipping(items, layouts, 16, wanted)
    return report.select("layout", "column_name", "files", (F.col("files_read") * 2 <= F.col("files")).alias("prunes"))
