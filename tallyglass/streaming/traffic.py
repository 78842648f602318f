"""The traffic job: records in, session counts out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyglass.sources.streams import (
    kafka_stream,
    parse_traffic,
    text_stream,
    write_jdbc_stream,
    write_parquet_stream,
)
from tallyglass.streaming.sessionize import sessionize_stream

TABLE = "sessionized_aggregated_events"


def run_from_files(
    spark: SparkSession, source: str, target: str, checkpoint: str, gap: str = "5 minutes", every: str | None = None
) -> StreamingQuery:
    """Session counts of JSON-lines files arriving in ``source``, as parquet."""
    events = parse_traffic(text_stream(spark, source))
    return write_parquet_stream(sessionize_stream(events, gap=gap), target, checkpoint, every)


def run_from_kafka(
    spark: SparkSession,
    servers: str,
    topic: str,
    url: str,
    properties: Mapping[str, str],
    checkpoint: str,
    username: str | None = None,
    password: str | None = None,
    group: str | None = None,
    table: str = TABLE,
) -> StreamingQuery:
    """Session counts of a Kafka topic into a database table.

    ``checkpoint`` must outlive the process: a restart goes on from its offsets.
    The query is returned running; a failure ends it and is raised by
    ``awaitTermination``.
    """
    extra = {"kafka.group.id": group} if group else None
    events = parse_traffic(kafka_stream(spark, servers, topic, username, password, extra=extra))
    return write_jdbc_stream(sessionize_stream(events), url, table, checkpoint, properties)
