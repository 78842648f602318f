"""File and table scans, and series of integers and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_scan(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header.  Without a schema the types are inferred, at the cost of a second read."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def parquet_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table_scan(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Register ``df`` as a temporary view and return the view."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """Print the schema and the first rows, and pass ``df`` on."""
    df.printSchema()
    df.show(rows)
    return df


def int_series(spark: SparkSession, first: int, last: int, name: str = "value") -> DataFrame:
    """Integers ``first..last``, made in parallel."""
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias(name))


def date_series(spark: SparkSession, first: str, last: str, name: str = "date") -> DataFrame:
    """Dates ``first..last``."""
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return spark.range(1).select(F.explode(days).alias(name))
