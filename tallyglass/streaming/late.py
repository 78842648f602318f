"""An account of a stream of events: what was read, what came too late, what is in sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyglass.sources.streams import parquet_stream, parse_traffic, text_stream, write_parquet_stream
from tallyglass.sources.tables import path_exists
from tallyglass.streaming.sessionize import sessionize_stream

ACCOUNT = (
    "batch_id bigint, events_read bigint, late_events bigint, untimed_events bigint, watermark timestamp, newest timestamp"
)


def account(spark: SparkSession, folder: str) -> DataFrame:
    """One row per batch that :func:`split_late` has finished."""
    path = f"{folder}/account"
    if not path_exists(spark, path):
        return spark.createDataFrame([], ACCOUNT)
    return spark.read.schema(ACCOUNT).option("recursiveFileLookup", "true").parquet(path)


def split_late(
    events: DataFrame, ts: str, gap_seconds: int, delay_seconds: int, folder: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Start writing events to ``folder``, those that come too late apart, with an account of every batch.

    The watermark of a batch is the newest time of the batches before, in whole milliseconds, less the delay.  An event is late
    if its own session, ``gap_seconds`` from its time, ends at the watermark or before; without a time it is in no session.
    Each batch is evaluated once: its rows go to ``rows/batch=<n>/kind=<on_time, late or untimed>`` while an observation counts
    them, and the account's row is written last.  A batch that is tried again replaces its rows and gives the same.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = account(spark, folder).filter(F.col("batch_id") < batch_id).agg(F.max("newest").alias("newest")).first()["newest"]
        at = F.col(ts).cast("timestamp")
        watermark = F.date_trunc("millisecond", F.lit(newest).cast("timestamp")) - F.make_dt_interval(secs=F.lit(delay_seconds))
        ends = at + F.make_dt_interval(secs=F.lit(gap_seconds))
        kind = F.when(at.isNull(), "untimed").when(ends <= watermark, "late").otherwise("on_time")
        seen = Observation()
        marked = batch.withColumn("kind", kind).observe(
            seen,
            F.count(F.lit(1)).alias("read"),
            F.count_if(F.col("kind") == "late").alias("late"),
            F.count_if(F.col("kind") == "untimed").alias("untimed"),
            F.max(at).alias("newest"),
        )
        marked.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("kind").parquet(f"{folder}/rows/batch={batch_id}")
        counts = seen.get
        row = spark.range(1).select(
            F.lit(batch_id).cast("bigint").alias("batch_id"),
            *[F.lit(counts[c]).cast("bigint").alias(f"events_{c}" if c == "read" else f"{c}_events") for c in ("read", "late", "untimed")],
            watermark.alias("watermark"),
            F.greatest(F.lit(newest).cast("timestamp"), F.lit(counts["newest"]).cast("timestamp")).alias("newest"),
        )
        row.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{folder}/account/batch={batch_id}")

    writer = events.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).foreachBatch(split).start()


def rows_of_kind(spark: SparkSession, folder: str, columns: T.StructType, kind: str) -> DataFrame:
    """The events split off as ``late``, ``untimed`` or ``on_time``."""
    path = f"{folder}/rows"
    if not path_exists(spark, path):
        return spark.createDataFrame([], columns)
    kinds = T.StructType([*columns.fields, T.StructField("batch", T.LongType()), T.StructField("kind", T.StringType())])
    return spark.read.schema(kinds).parquet(path).filter(F.col("kind") == kind).select(*columns.fieldNames())


def run_counted(spark: SparkSession, source: str, folder: str, gap_seconds: int, delay_seconds: int = 15) -> None:
    """The traffic job over what has arrived in ``source``, with an account; run again after more has arrived.

    First the new lines are split, then sessions are made of those that are on time.  As the sessions' own watermark is never
    ahead of the one the split used, they drop nothing more: the events read are the late and untimed ones, the hits of the
    sessions written and the hits of sessions still open.  A run that fails is run again before more is split.
    """
    events = parse_traffic(text_stream(spark, source))
    columns = events.schema
    split_late(events, "window_timestamp", gap_seconds, delay_seconds, folder, f"{folder}/split-log").awaitTermination()
    if rows_of_kind(spark, folder, columns, "on_time").isEmpty():
        return
    on_time = parquet_stream(spark, f"{folder}/rows/batch=*/kind=on_time", columns)
    sessions = sessionize_stream(on_time, gap=f"{gap_seconds} seconds", delay=f"{delay_seconds} seconds")
    write_parquet_stream(sessions, f"{folder}/sessions", f"{folder}/session-log", every=None).awaitTermination()


def closed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions written so far."""
    columns = "event_hour timestamp, ip string, host string, num_hits bigint"
    if not path_exists(spark, f"{folder}/sessions"):
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).parquet(f"{folder}/sessions")


def open_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """The sessions still open, as the job's state store holds them after its last batch."""
    state = spark.read.format("statestore").load(f"{folder}/session-log")
    return state.select("key", "value")


def balance(spark: SparkSession, folder: str) -> DataFrame:
    """One row: events read, late, without a time, in closed sessions and in open ones, and whether they add up."""
    totals = account(spark, folder).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("events_read", "late_events", "untimed_events")])
    closed = closed_sessions(spark, folder).agg(F.coalesce(F.sum("num_hits"), F.lit(0)).alias("closed_hits"))
    held = open_sessions(spark, folder).agg(F.coalesce(F.sum("value.count"), F.lit(0)).alias("open_hits"))
    both = totals.crossJoin(closed).crossJoin(held)
    counted = F.col("late_events") + F.col("untimed_events") + F.col("closed_hits") + F.col("open_hits")
    return both.withColumn("agrees", F.col("events_read") == counted)
