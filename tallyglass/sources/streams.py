"""Stream sources and sinks.

The Kafka and JDBC connectors need their jars on the class path; the functions
only set the options.  File streams and parquet sinks need nothing else.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyglass.sources.schemas import schema
from tallyglass.sources.tables import upsert

# Fixed value: the event-time text of the traffic records.
ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSX"


def kafka_stream(
    spark: SparkSession,
    servers: str,
    topic: str,
    username: str | None = None,
    password: str | None = None,
    starting: str = "latest",
    extra: Mapping[str, str] | None = None,
) -> DataFrame:
    """JSON records of a topic as a string column ``value``."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if username is not None:
        login = "org.apache.kafka.common.security.plain.PlainLoginModule"
        options |= {
            "kafka.security.protocol": "SASL_SSL",
            "kafka.sasl.mechanism": "PLAIN",
            "kafka.sasl.jaas.config": f'{login} required username="{username}" password="{password}";',
        }
    reader = spark.readStream.format("kafka").options(**(options | dict(extra or {})))
    return reader.load().select(F.col("value").cast("string").alias("value"))


def text_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of files arriving in a folder as a string column ``value``."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def parquet_stream(spark: SparkSession, path: str, columns: T.StructType | str, glob: str | None = None) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(columns)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def parse_traffic(
    raw: DataFrame, record: T.StructType | None = None, time: str = "event_time", pattern: str = ISO_PATTERN
) -> DataFrame:
    """Traffic records from JSON text, with their event time as ``window_timestamp``.

    Text that does not parse gives NULLs.  The zone is read from the text, so
    the instant is right whatever the session's zone.
    """
    parsed = raw.select(F.from_json("value", record or schema("web_traffic")).alias("r")).select("r.*")
    return parsed.withColumn("window_timestamp", F.try_to_timestamp(F.col(time), F.lit(pattern)))


def write_parquet_stream(
    stream: DataFrame, path: str, checkpoint: str, every: str | None = "10 seconds"
) -> StreamingQuery:
    """Start appending to parquet; ``every=None`` takes what is there and stops."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start(path)


def write_jdbc_stream(
    stream: DataFrame,
    url: str,
    table: str,
    checkpoint: str,
    properties: Mapping[str, str],
    every: str = "10 seconds",
    batch_column: str | None = "batch_id",
) -> StreamingQuery:
    """Start appending micro-batches to a database table, at least once.

    A batch that is tried again after a failure appends its rows again, so the
    batch number is written too, and readers can keep one copy by number and
    key; ``batch_column=None`` leaves it out.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        numbered = batch if batch_column is None else batch.withColumn(batch_column, F.lit(batch_id))
        numbered.write.jdbc(url, table, mode="append", properties=dict(properties))

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).foreachBatch(append).start()


def write_upsert_stream(
    stream: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str], checkpoint: str,
    every: str | None = "10 seconds",
) -> StreamingQuery:
    """Start upserting micro-batches into a partitioned parquet table.

    A repeated batch gives the same table.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert(batch.sparkSession, path, batch, keys, partition_by)

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).foreachBatch(merge).start()
