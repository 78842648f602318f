"""Product metrics over an event table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.operators.datelist import datelist_int_from_events
from tallyglass.operators.sessions import sessionize_batch, week_of


def sessions_per_week(events: DataFrame, user: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions and seconds spent per user and week, by the session's start."""
    sessions = sessionize_batch(events, [user], ts, gap_seconds)
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("session_last", "session_start")]
    return (
        sessions.groupBy(user, week_of("session_start").alias("week"))
        .agg(F.count(F.lit(1)).alias("session_count"), F.sum(micros[0] - micros[1]).alias("_spent"))
        .select(user, "week", "session_count", (F.col("_spent") / 1e6).alias("seconds_spent"))
    )


def actions_per_user(events: DataFrame, user: str, action: str, actions: Sequence[str]) -> DataFrame:
    """One count column per listed action."""
    return events.groupBy(user).agg(*[F.count_if(F.col(action) == a).alias(f"{a}_count") for a in actions])


def rate_between(
    events: DataFrame, by: Sequence[str | Column], user: str, reached: Column, base: Column, name: str = "rate"
) -> DataFrame:
    """Distinct users with a ``reached`` event over distinct users with a ``base`` event; one event may be both."""
    counted = events.filter(reached | base).groupBy(*by).agg(
        F.count_distinct(F.when(base, F.col(user))).alias("base_users"),
        F.count_distinct(F.when(reached, F.col(user))).alias("reached_users"),
    )
    return counted.withColumn(name, F.try_divide(F.col("reached_users").cast("double"), F.col("base_users")))


def _active_days(events: DataFrame, user: str, day: Column) -> DataFrame:
    """First day and the set of active days per user; bounded by the calendar."""
    days = events.select(user, day.alias("_day"))
    return days.groupBy(user).agg(F.min("_day").alias("_first"), F.collect_set("_day").alias("_days"))


def retention(events: DataFrame, user: str, day: Column, within: Sequence[int], as_of) -> DataFrame:
    """Per first-seen day: users, and those active again within each number of days.

    Only cohorts whose window has passed by ``as_of`` have a value.
    """
    users = _active_days(events, user, day)

    def back(days: int) -> Column:
        age = lambda d: F.datediff(d, F.col("_first"))
        return F.exists("_days", lambda d: (age(d) >= 1) & (age(d) <= days))

    counts = [
        F.when(F.datediff(F.lit(as_of).cast("date"), F.col("_first")) >= n, F.count_if(back(n))).alias(f"retained_{n}d")
        for n in within
    ]
    return users.groupBy("_first").agg(F.count(F.lit(1)).alias("cohort_users"), *counts).withColumnRenamed(
        "_first", "cohort_day"
    )


def churn(events: DataFrame, user: str, day: Column, quiet_days: int, as_of) -> DataFrame:
    """Users seen before the last ``quiet_days`` days, and those not seen since."""
    until = F.lit(as_of).cast("date")
    last_seen = events.select(user, day.alias("_day")).filter(F.col("_day") <= until).groupBy(user).agg(
        F.min("_day").alias("_first"), F.max("_day").alias("_last")
    )
    edge = F.date_sub(until, quiet_days)
    return last_seen.filter(F.col("_first") <= edge).agg(
        F.count(F.lit(1)).alias("known_users"), F.count_if(F.col("_last") <= edge).alias("churned_users")
    )


def active_users(events: DataFrame, user: str, day: Column, as_of) -> DataFrame:
    """Daily, weekly and monthly active users on a day, from the 32-bit fields."""
    fields = datelist_int_from_events(events, [user], day, as_of)
    return fields.agg(
        F.count_if("dim_is_daily_active").alias("daily_active_users"),
        F.count_if("dim_is_weekly_active").alias("weekly_active_users"),
        F.count_if("dim_is_monthly_active").alias("monthly_active_users"),
    )


def daily_user_bitmaps(events: DataFrame, user: str, day: Column) -> DataFrame:
    """Users of each day as bitmaps: ``day``, ``bucket`` and ``users``, a bit for each number in the bucket.

    ``user`` is a whole number; a bucket of 32,768 of them takes 4 kB, so numbers should lie close together.  Bitmaps of parts
    of a day, or of several days, merge by ``bitmap_or_agg``.
    """
    known = events.select(F.col(user).cast("bigint").alias("_user"), day.alias("day")).filter("_user is not null and day is not null")
    return known.groupBy("day", F.bitmap_bucket_number("_user").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_user")).alias("users")
    )


def active_users_series(bitmaps: DataFrame, windows: Mapping[str, int]) -> DataFrame:
    """Distinct users of the last so many days, for every day from the first to the last: one column per window.

    ``bitmaps`` come from :func:`daily_user_bitmaps`, in any number of parts per day and bucket.  A bucket's bitmaps of a
    frame are or'ed, so a task holds one bucket's rows, one per day.
    """
    merged = bitmaps.groupBy("day", "bucket").agg(F.bitmap_or_agg("users").alias("users"))
    by_day = Window.partitionBy("bucket").orderBy("_number")
    numbered = merged.select("bucket", F.unix_date("day").alias("_number"), "users")
    # a bucket's rows go on, without users, until its next day or until no window reaches back to it
    longest = max(windows.values())
    span = F.least(F.coalesce(F.lead("_number").over(by_day) - F.col("_number"), F.lit(longest)), F.lit(longest))
    rows = numbered.withColumn("_span", span).select(
        "bucket", "_number", "users", F.explode(F.sequence(F.lit(0), F.col("_span") - 1)).alias("_later")
    )
    seen = F.when(F.col("_later") == 0, F.col("users"))
    filled = rows.select("bucket", (F.col("_number") + F.col("_later")).alias("_number"), seen.alias("users"))
    counts = [F.bitmap_count(F.bitmap_or_agg("users").over(by_day.rangeBetween(1 - n, 0))).alias(name) for name, n in windows.items()]
    counted = filled.select("_number", F.col("users").isNotNull().alias("_seen"), *counts)
    per_day = counted.groupBy(F.date_from_unix_date("_number").alias("day")).agg(
        F.bool_or("_seen").alias("_seen"), *[F.sum(name).alias(name) for name in windows]
    )
    return _every_day(per_day, list(windows), keep=False)


def _every_day(rows: DataFrame, names: Sequence[str], keep: bool) -> DataFrame:
    """``rows``, one per day, up to the last day that is ``_seen``, with a row for each day between them.

    A day between has the values of the day before it if ``keep``, else 0.  The rows are as many as the calendar has days.
    """
    in_order = Window.orderBy("day")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.max(F.when(F.col("_seen"), F.col("day"))).over(whole)
    placed = rows.withColumn("_next", F.lead("day").over(in_order)).withColumn("_last", last).filter(F.col("day") <= F.col("_last"))
    end = F.coalesce(F.least(F.date_sub("_next", 1), F.col("_last")), F.col("_last"))
    between = placed.withColumn("_first", F.col("day")).withColumn("day", F.explode(F.sequence("day", end)))
    value = lambda n: F.col(n) if keep else F.when(F.col("day") == F.col("_first"), F.col(n)).otherwise(0)
    return between.select("day", *[value(n).cast("bigint").alias(n) for n in names])


def active_users_by_day(events: DataFrame, user: str, day: Column, windows: Mapping[str, int]) -> DataFrame:
    """:func:`active_users_series` for users of any type, without bitmaps.

    A user counts in a window of ``n`` days from each of its days on, until ``n`` days or its next day.  These stretches
    become a plus and a minus on their edges, which are summed per day on the map side; what is then added up from day to
    day has one row per day of the calendar.
    """
    days = events.select(F.col(user).alias("_user"), day.alias("day")).filter("_user is not null and day is not null").distinct()
    gap = F.datediff(F.lead("day").over(Window.partitionBy("_user").orderBy("day")), F.col("day"))
    gaps = days.select("day", gap.alias("_gap"))
    names = list(windows)
    zero = F.lit(0)
    starts = F.struct(F.col("day").alias("day"), F.lit(True).alias("seen"), *[F.lit(1).alias(n) for n in names])
    ends = [
        F.struct(
            F.date_add("day", F.coalesce(F.least(F.lit(windows[n]), F.col("_gap")), F.lit(windows[n]))).alias("day"),
            F.lit(False).alias("seen"),
            *[(F.lit(-1) if m == n else zero).alias(m) for m in names],
        )
        for n in names
    ]
    changes = gaps.select(F.inline(F.array(starts, *ends))).groupBy("day").agg(
        F.bool_or("seen").alias("_seen"), *[F.sum(n).alias(n) for n in names]
    )
    until_now = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = changes.select("day", "_seen", *[F.sum(n).over(until_now).alias(n) for n in names])
    return _every_day(totals, names, keep=True)


def completion_rate(df: DataFrame, by: Sequence[str], done: Column, total: Column, at_least: float = 0.9) -> DataFrame:
    """Share of rows in which ``done`` is at least that part of ``total``."""
    complete = F.when(total > 0, F.when(done >= total * at_least, 1).otherwise(0))
    return df.groupBy(*by).agg(
        F.count(complete).alias("row_count"), F.sum(complete).alias("completed"), F.avg(complete).alias("completion_rate")
    )


def net_promoter_score(df: DataFrame, by: Sequence[str], score: Column) -> DataFrame:
    """Promoters (9-10) minus detractors (0-6), in percent of answers from 0 to 10."""
    rated = df.select(*by, score.alias("_score")).filter(F.col("_score").between(0, 10))
    counted = rated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("answers"),
        F.count_if(F.col("_score") >= 9).alias("promoters"),
        F.count_if(F.col("_score") <= 6).alias("detractors"),
    )
    points = (F.col("promoters") - F.col("detractors")).cast("double") * 100 / F.col("answers")
    return counted.withColumn("net_promoter_score", points)


def experiment_cells(df: DataFrame, user: str, experiment: str, cells: Mapping[str, int]) -> DataFrame:
    """Assign each row's user to a cell by a stable hash; ``cells`` maps names to percents."""
    if sum(cells.values()) != 100:
        raise ValueError("cell percents must add up to 100")
    text = F.concat(F.lit(f"{experiment}:"), F.col(user).cast("string"))
    percent = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100
    cell, edge = None, 0
    for name, share in cells.items():
        edge += share
        cell = F.when(percent < edge, name) if cell is None else cell.when(percent < edge, name)
    return df.withColumn("cell", cell)
