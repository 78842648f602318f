"""Checks on incoming tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions.skew import HOT_ROWS, time_chunks
from tallyglass.session import fresh_path


def completeness(
    events: DataFrame, by: Sequence[str], day: Column, trailing: int = 7, at_least: float = 0.5, as_of=None
) -> DataFrame:
    """Rows per day against the mean of the days before; ``is_low`` marks a drop.

    Each key has every day from its first to ``as_of`` (by default the newest day of any key), with 0 rows where it has
    none, so an outage is a drop too and the trailing days are days of the calendar.  The window runs over at most one row
    per day and key.
    """
    daily = events.groupBy(*by, day.alias("day")).agg(F.count(F.lit(1)).alias("_rows")).filter("day is not null")
    until = None if as_of is None else F.lit(as_of).cast("date")
    return _against_trailing(daily, by, "day", until, F.expr("interval 1 day"), trailing, at_least)


def completeness_by_hour(
    events: DataFrame, by: Sequence[str], ts: str, as_of, trailing: int = 24, at_least: float = 0.5
) -> DataFrame:
    """:func:`completeness` by hour, up to the hour of ``as_of``."""
    hourly = events.groupBy(*by, F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("_rows"))
    until = F.date_trunc("hour", F.lit(as_of).cast("timestamp"))
    return _against_trailing(hourly.filter("hour is not null"), by, "hour", until, F.expr("interval 1 hour"), trailing, at_least)


def _against_trailing(
    counts: DataFrame, by, unit: str, until: Column | None, step: Column, trailing: int, at_least: float
) -> DataFrame:
    # first and newest as structs with the count, so that all three readers of the counts share one exchange
    dated = F.struct(unit, "_rows")
    if until is None:
        until = counts.agg(F.max(dated)).scalar().getField(unit)
    else:
        counts = counts.filter(F.col(unit) <= until)
    calendar = counts.groupBy(*by).agg(F.min(dated).getField(unit).alias("_first")).select(
        *by, F.explode(F.sequence("_first", until, step)).alias(unit), F.lit(0).cast("bigint").alias("_rows")
    )
    filled = counts.unionByName(calendar).groupBy(*by, unit).agg(F.sum("_rows").alias("row_count"))
    before = Window.partitionBy(*by).orderBy(unit).rowsBetween(-trailing, -1)
    return filled.withColumn("trailing_mean", F.avg("row_count").over(before)).withColumn(
        "is_low", F.coalesce(F.col("row_count") < F.col("trailing_mean") * at_least, F.lit(False))
    )


def freshness(events: DataFrame, by: Sequence[str], ts: str, as_of, max_days: int = 1) -> DataFrame:
    """Newest row per key and its age in days on ``as_of``."""
    newest = events.groupBy(*by).agg(F.max(ts).alias("newest"))
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("newest"))
    return newest.withColumn("age_days", age).withColumn("is_stale", F.col("age_days") > max_days)


def record_schemas(records: DataFrame, day: Column, text: str) -> DataFrame:
    """Fields of JSON records per day: ``day``, ``field``, its type over all the day's records, and how many have it.

    Types are those of the values: whole numbers ``BIGINT``, others ``DECIMAL`` or ``DOUBLE`` without their size, a mix
    ``VARIANT``, nested records with their own fields.  A text that is no JSON object has no fields; a day without any has
    one row with a NULL field.  One aggregate, combined on the map side.
    """
    parsed = records.select(day.alias("day"), F.try_parse_json(text).alias("_record")).filter("day is not null")
    is_object = F.schema_of_variant("_record").startswith("OBJECT")
    objects = parsed.withColumn("_record", F.when(is_object, F.col("_record")))
    fields = objects.lateralJoin(records.sparkSession.tvf.variant_explode_outer(F.col("_record").outer()))
    kind = F.regexp_replace(F.schema_of_variant_agg("value"), r"DECIMAL\(\d+,\d+\)", "DECIMAL")
    return fields.groupBy("day", F.col("key").alias("field")).agg(
        F.when(F.col("field").isNotNull(), kind).alias("type"), F.count(F.lit(1)).alias("row_count")
    )


def record_drift(records: DataFrame, day: Column, text: str) -> DataFrame:
    """Fields of JSON records per day against the first day: ``drift`` is ``added``, ``missing``, ``type`` or NULL.

    A row per day and field of that day or of the first one: ``base_type``, ``found_type`` and the day's records that have
    the field.  What is compared has one row per day and field; the first day and its fields are subqueries of it.
    """
    found = record_schemas(records, day, text)
    # whole rows everywhere, so that all readers share the aggregate's exchange
    whole = F.struct("day", "field", "type", "row_count")
    first = found.agg(F.min(whole)).scalar().getField("day")
    of_first = F.when((F.col("day") == first) & F.col("field").isNotNull(), F.struct("field", F.col("type").alias("base_type"), "row_count"))
    base = found.agg(F.collect_list(of_first)).scalar()
    days = found.groupBy("day").agg(F.max(whole).alias("_any")).filter("_any is not null")
    wanted = days.select("day", F.inline(base)).drop("row_count")
    both = wanted.join(found.withColumnRenamed("type", "found_type"), ["day", "field"], "full").filter("field is not null")
    drift = (
        F.when(F.col("base_type").isNull(), "added")
        .when(F.col("found_type").isNull(), "missing")
        .when(F.col("base_type") != F.col("found_type"), "type")
    )
    rows = F.coalesce("row_count", F.lit(0).cast("bigint")).alias("row_count")
    return both.select("day", "field", "base_type", "found_type", drift.alias("drift"), rows)


def schema_drift(spark: SparkSession, found: T.StructType, expected: T.StructType) -> DataFrame:
    """Columns missing, added or of another type, by name."""
    have = {f.name: f.dataType.simpleString() for f in found.fields}
    want = {f.name: f.dataType.simpleString() for f in expected.fields}
    rows = [
        (name, want.get(name), have.get(name), "missing" if name not in have else "added" if name not in want else "type")
        for name in sorted(have.keys() | want.keys())
        if have.get(name) != want.get(name)
    ]
    return spark.createDataFrame(rows, "column string, expected string, found string, drift string")


def malformed_split(
    df: DataFrame, text: str, record: str, rules: Mapping[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Split rows into good ones and bad ones with the first reason.

    ``text`` is parsed as JSON into column ``record_value``; a text that does
    not parse is bad, then a row for which a rule is false or NULL.
    """
    wanted = T.StructType.fromDDL(record).add("_corrupt", T.StringType())
    parsed = df.withColumn("record_value", F.from_json(text, wanted, {"columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col(text).isNull() | F.col("record_value").isNull() | F.col("record_value._corrupt").isNotNull()
    reason = F.when(broken, "unparsed")
    for name, rule in rules.items():
        reason = reason.when(~F.coalesce(rule, F.lit(False)), name)
    marked = parsed.withColumn("reason", reason)
    good = marked.filter(F.col("reason").isNull()).drop("reason")
    clean = F.col("record_value").dropFields("_corrupt")
    return good.withColumn("record_value", clean), marked.filter(F.col("reason").isNotNull()).drop("record_value")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.filter(F.col("row_count") > 1)


def fast_users(events: DataFrame, user: str, ts: str, unit: str, more_than: int) -> DataFrame:
    """Users with more than ``more_than`` events in some time unit, and their highest rate."""
    rates = events.groupBy(user, F.date_trunc(unit, ts).alias("_unit")).agg(F.count(F.lit(1)).alias("_n"))
    return rates.groupBy(user).agg(F.max("_n").alias("max_rate")).filter(F.col("max_rate") > more_than)


def without_fast_users(events: DataFrame, user: str, ts: str, unit: str, more_than: int) -> DataFrame:
    """Events of the users :func:`fast_users` does not list."""
    return events.join(fast_users(events, user, ts, unit, more_than).select(user), user, "left_anti")


def sliding_rates(events: DataFrame, user: str, ts: str, seconds: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per user the most events in any ``seconds`` in a row, ``max_rate``; a NULL time counts in none.

    Events of one instant are counted first, so a burst reaches its window as one row per microsecond, and a hot user's
    windows run in chunks of time.
    """
    reach = seconds * 1_000_000
    timed = events.select(user, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at")).filter("_at is not null")
    instants = timed.groupBy(user, "_at").agg(F.count(F.lit(1)).alias("_n"))
    chunks = time_chunks(instants, user, "_at", before=reach, threshold=hot_rows)
    frame = Window.partitionBy(user, "_chunk").orderBy("_at").rangeBetween(1 - reach, 0)
    rates = chunks.withColumn("_rate", F.sum("_n").over(frame)).filter("_own")
    return rates.groupBy(user).agg(F.max("_rate").alias("max_rate"))


def fast_users_sliding(
    events: DataFrame, user: str, ts: str, seconds: int, more_than: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Users with more than ``more_than`` events in some ``seconds`` in a row, across the edges of calendar units too."""
    return sliding_rates(events, user, ts, seconds, hot_rows).filter(F.col("max_rate") > more_than)


def without_fast_users_sliding(events: DataFrame, user: str, ts: str, seconds: int, more_than: int) -> DataFrame:
    """Events of the users :func:`fast_users_sliding` does not list."""
    return events.join(fast_users_sliding(events, user, ts, seconds, more_than).select(user), user, "left_anti")


def unknown_names(events: DataFrame, name: str, known: Sequence[str] | DataFrame) -> DataFrame:
    """Names in use that are not known, with their rows.

    Names are counted first, so the anti join meets one row per name.
    """
    used = events.groupBy(name).agg(F.count(F.lit(1)).alias("row_count"))
    if isinstance(known, DataFrame):
        return used.join(known.select(name).distinct(), name, "left_anti")
    return used.filter(~F.coalesce(F.col(name).isin(*known), F.lit(False)))


def cardinality(df: DataFrame, columns: Sequence[str], limit: int, exact: bool = False) -> DataFrame:
    """Distinct values per column, approximate unless ``exact``, and whether above ``limit``."""
    count = F.count_distinct if exact else F.approx_count_distinct
    wide = df.agg(*[count(F.col(c)).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("distinct_values")) for c in columns])
    return wide.select(F.inline(entries)).withColumn("is_high", F.col("distinct_values") > limit)


def cardinality_closeness(df: DataFrame, columns: Sequence[str], limit: int, rsd: float = 0.05) -> DataFrame:
    """Per column whether the approximate count is above ``limit``, and whether it is within three standard errors of the exact one."""
    wide = df.agg(
        *[F.approx_count_distinct(F.col(c), rsd).alias(f"about_{c}") for c in columns],
        *[F.count_distinct(F.col(c)).alias(f"exact_{c}") for c in columns],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            (F.col(f"about_{c}") > limit).alias("is_high"),
            (F.abs(F.col(f"about_{c}") - F.col(f"exact_{c}")) <= 3 * rsd * F.col(f"exact_{c}")).alias("is_close"),
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*entries)))


def daily_by_zone(events: DataFrame, ts: str, zone: str) -> DataFrame:
    """Rows per UTC day and per day of ``zone``, for UTC event times."""
    local = F.from_utc_timestamp(F.col(ts), zone)
    days = F.array(
        F.struct(F.lit("UTC").alias("zone"), F.to_date(ts).alias("day")),
        F.struct(F.lit(zone).alias("zone"), F.to_date(local).alias("day")),
    )
    return events.select(F.inline(days)).groupBy("zone", "day").agg(F.count(F.lit(1)).alias("row_count"))


def layout_sizes(
    df: DataFrame, layouts: Mapping[str, tuple[Sequence[str], Sequence[str]]], n_files: int
) -> DataFrame:
    """Write ``df`` once per layout and report files, bytes and rows.

    A layout is (cluster columns, sort columns): rows are sent to files by
    ranges of the first, ties by the second, so a frequent value fills several
    files, and sorted inside a file by the second.
    """
    spark = df.sparkSession
    result = None
    for name, (spread, sort) in layouts.items():
        path = fresh_path(spark, f"layout-{name}")
        ranges = [*spread, *[c for c in sort if c not in spread]]
        placed = df.repartitionByRange(n_files, *ranges) if ranges else df.repartition(n_files)
        (placed.sortWithinPartitions(*sort) if sort else placed).write.parquet(path)
        # One row per file before the sum, however many rows the file holds.
        files = (
            spark.read.parquet(path)
            .groupBy("_metadata.file_path")
            .agg(F.max("_metadata.file_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
        )
        sizes = files.agg(
            F.count(F.lit(1)).alias("files"), F.sum("_bytes").alias("bytes"), F.sum("_rows").alias("row_count")
        ).select(F.lit(name).alias("layout"), "*")
        result = sizes if result is None else result.unionByName(sizes)
    return result
