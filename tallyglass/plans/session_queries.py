"""Sessions of events, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.operators.sessions import session_avg, session_check, session_compare, sessionize_batch
from tallyglass.plans.registry import query
from tallyglass.session import fresh_path
from tallyglass.sources.bindings import Tables
from tallyglass.sources.streams import parquet_stream, write_parquet_stream
from tallyglass.streaming.late import account, balance, run_counted
from tallyglass.streaming.sessionize import sessionize_stream
from tallyglass.streaming.traffic import run_from_files

FIVE_MINUTES, SIX_HOURS = 300, 21_600
KEYS = ["user_id", "event_type"]


def sessions_sql(seconds: int, keys: str = "user_id, event_type") -> str:
    return f"""stepped AS (
  SELECT {keys}, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY {keys} ORDER BY ts) <= INTERVAL {seconds} SECOND
         THEN 0 ELSE 1 END AS opens FROM events),
named AS (SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM stepped),
sessions AS (SELECT {keys}, min(ts) AS session_start, max(ts) AS session_last, count(*) AS num_hits
             FROM named GROUP BY {keys}, session)"""


def sessions(t: Tables, seconds: int):
    return sessionize_batch(t.events, KEYS, "ts", seconds)


@query("sessionize_batch", f"WITH {sessions_sql(FIVE_MINUTES)} SELECT * FROM sessions")
def q_sessions(t: Tables):
    return sessions(t, FIVE_MINUTES)


@query("sessionize_batch_six_hours", f"WITH {sessions_sql(SIX_HOURS)} SELECT * FROM sessions")
def q_sessions_long(t: Tables):
    return sessions(t, SIX_HOURS)


@query(
    "sessionize_stream",
    f"""WITH {sessions_sql(SIX_HOURS)}
    SELECT session_start, user_id, event_type, num_hits FROM sessions
    WHERE session_last + INTERVAL {SIX_HOURS} SECOND <= (SELECT max(ts) FROM events) - INTERVAL 15 SECOND""",
)
def q_stream(t: Tables):
    """The event file as a stream; sessions the watermark has not passed stay open."""
    spark = t.spark
    raw = parquet_stream(spark, t.sf_dir, t.events.schema, glob="events.parquet")
    events = raw.select(*KEYS, F.col("ts").cast("timestamp").alias("ts"))
    closed = sessionize_stream(events, KEYS, "ts", gap=f"{SIX_HOURS} seconds", start="session_start")
    out = fresh_path(spark, "sessions")
    write_parquet_stream(closed, out, fresh_path(spark, "sessions-log"), every=None).awaitTermination()
    return spark.read.schema(closed.schema).parquet(out).withColumn(
        "session_start", F.col("session_start").cast("timestamp_ntz")
    )


def traffic_lines(events):
    """Events as the traffic topic has them: JSON text with ISO times in milliseconds."""
    time = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    fields = [F.col("user_id").cast("string").alias("ip"), F.col("event_type").alias("host"), time.alias("event_time")]
    return events.select(F.to_json(F.struct(*fields)).alias("value"))


def traffic_sql(kept: str, newest: str) -> str:
    """Sessions per address and host of the lines that are not late, once the watermark has passed them."""
    return f"""WITH lines AS (SELECT CAST(user_id AS VARCHAR) AS ip, event_type AS host, date_trunc('milliseconds', ts) AS ts FROM events WHERE {kept}),
    stepped AS (SELECT ip, host, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY ip, host ORDER BY ts) <= INTERVAL {SIX_HOURS} SECOND
                THEN 0 ELSE 1 END AS opens FROM lines),
    named AS (SELECT *, sum(opens) OVER (PARTITION BY ip, host ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM stepped)
    SELECT min(ts) AS event_hour, ip, host, count(*) AS num_hits FROM named GROUP BY ip, host, session
    HAVING max(ts) + INTERVAL {SIX_HOURS} SECOND <= (SELECT {newest} FROM events) - INTERVAL 15 SECOND"""


def _traffic_job(t: Tables, *arrivals):
    """The traffic job run once after each arrival of lines, as a service that is stopped and started again."""
    source, out, log = (fresh_path(t.spark, f"traffic-{n}") for n in ("in", "out", "log"))
    for events in arrivals:
        traffic_lines(events).write.mode("append").text(source)
        run_from_files(t.spark, source, out, log, gap=f"{SIX_HOURS} seconds").awaitTermination()
    sessions = t.spark.read.schema("event_hour timestamp, ip string, host string, num_hits bigint").parquet(out)
    return sessions.withColumn("event_hour", F.col("event_hour").cast("timestamp_ntz"))


@query("traffic_sessions", traffic_sql("true", "date_trunc('milliseconds', max(ts))"))
def q_traffic(t: Tables):
    return _traffic_job(t, t.events)


LATE = "event_id % 10 = 0 AND ts < (SELECT max(ts) FROM events) - INTERVAL 5 DAY"


@query("traffic_sessions_late", traffic_sql(f"NOT ({LATE})", "date_trunc('milliseconds', max(ts))"))
def q_traffic_late(t: Tables):
    """Three arrivals: all but the newest day and the late rows, the newest day, and the late rows, which are dropped."""
    newest = t.events.agg(F.max("ts")).first()[0]
    late = (F.col("event_id") % 10 == 0) & (F.col("ts") < F.lit(newest) - F.expr("interval 5 days"))
    today = F.to_date("ts") == F.lit(newest).cast("date")
    return _traffic_job(t, t.events.filter(~late & ~today), t.events.filter(~late & today), t.events.filter(late))


ARRIVALS = f"""arrivals AS (SELECT CASE WHEN {LATE} THEN 2 WHEN CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM events) THEN 1 ELSE 0 END AS batch_id,
    date_trunc('milliseconds', ts) AS moment FROM events)"""


def _counted(t: Tables) -> str:
    """The counted traffic job run after each of the three arrivals of :func:`q_traffic_late`; its folder."""
    newest = t.events.agg(F.max("ts")).first()[0]
    late = (F.col("event_id") % 10 == 0) & (F.col("ts") < F.lit(newest) - F.expr("interval 5 days"))
    today = F.to_date("ts") == F.lit(newest).cast("date")
    source, folder = fresh_path(t.spark, "traffic-in"), fresh_path(t.spark, "traffic-counted")
    for part in (~late & ~today, ~late & today, late):
        traffic_lines(t.events.filter(part)).write.mode("append").text(source)
        run_counted(t.spark, source, folder, SIX_HOURS)
    return folder


@query(
    "traffic_account",
    f"""WITH {ARRIVALS},
    batches AS (SELECT batch_id, count(*) AS events_read, max(moment) AS last FROM arrivals GROUP BY batch_id),
    timed AS (SELECT *, max(last) OVER (ORDER BY batch_id) AS newest,
              max(last) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 15 SECOND AS watermark FROM batches),
    late AS (SELECT batch_id, count(*) AS n FROM arrivals JOIN timed USING (batch_id) WHERE moment + INTERVAL {SIX_HOURS} SECOND <= watermark GROUP BY batch_id)
    SELECT CAST(batch_id AS BIGINT) AS batch_id, events_read, coalesce(n, 0) AS late_events, CAST(0 AS BIGINT) AS untimed_events, watermark, newest
    FROM timed LEFT JOIN late USING (batch_id)""",
)
def q_account(t: Tables):
    """What each batch of the counted job read, and how much of it came too late."""
    rows = account(t.spark, _counted(t))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("watermark", "newest")})


@query(
    "traffic_balance",
    f"""WITH closed AS ({traffic_sql(f'NOT ({LATE})', "date_trunc('milliseconds', max(ts))")}),
    totals AS (SELECT count(*) AS events_read, count(*) FILTER (WHERE {LATE}) AS late_events, CAST(0 AS BIGINT) AS untimed_events,
               (SELECT CAST(sum(num_hits) AS BIGINT) FROM closed) AS closed_hits FROM events)
    SELECT *, events_read - late_events - closed_hits AS open_hits, true AS agrees FROM totals""",
)
def q_balance(t: Tables):
    """Events read against late ones, hits of closed sessions and hits of those the state store still holds."""
    return balance(t.spark, _counted(t))


@query(
    "session_avg",
    f"""WITH {sessions_sql(SIX_HOURS)}
    SELECT avg(num_hits) AS average_events_per_session FROM sessions WHERE event_type LIKE '%r'""",
)
def q_session_avg(t: Tables):
    return session_avg(sessions(t, SIX_HOURS), "event_type", "r")


@query(
    "session_compare",
    f"""WITH {sessions_sql(SIX_HOURS)}
    SELECT event_type, avg(num_hits) AS average_events_per_session, count(*) AS total_sessions,
           CAST(sum(num_hits) AS BIGINT) AS total_hits
    FROM sessions WHERE event_type IN ('click', 'view', 'absent') GROUP BY event_type""",
)
def q_session_compare(t: Tables):
    return session_compare(sessions(t, SIX_HOURS), "event_type", ["click", "view", "absent"])


@query(
    "session_hits_check",
    "SELECT count(ts) AS event_count, count(ts) AS session_hits, true AS agrees FROM events",
)
def q_session_check(t: Tables):
    return session_check(t.events, sessions(t, FIVE_MINUTES), "ts")
