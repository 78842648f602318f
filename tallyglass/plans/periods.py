"""Run a step operator period by period over a snapshot table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.sources.tables import (
    create_bucketed_snapshots,
    overwrite_partition,
    overwrite_table,
    path_exists,
)


def empty_snapshot(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """The snapshot before the first period."""
    return spark.createDataFrame([], schema)


def run_periods(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    period: str,
    periods: Iterable[Any],
    step: Callable[[DataFrame, Any], DataFrame],
    previous: Callable[[Any], Any] = lambda p: p - 1,
) -> DataFrame:
    """Write one snapshot partition per period and return the table.

    Each step reads the partition written before it, so the plan of a period
    does not grow with the number of periods.  Running a period again replaces
    its own partition only.  ``step`` gets the previous snapshot and the period.
    """
    for at in periods:
        if path_exists(spark, path):
            prev = spark.read.schema(schema).parquet(path).filter(F.col(period) == F.lit(previous(at)))
        else:
            prev = empty_snapshot(spark, schema)
        overwrite_partition(step(prev, at).select(*schema.names), path, [period])
    return spark.read.schema(schema).parquet(path)


def run_periods_bucketed(
    spark: SparkSession,
    name: str,
    path: str,
    schema: T.StructType,
    period: str,
    periods: Iterable[Any],
    step: Callable[[DataFrame, Any], DataFrame],
    keys: Sequence[str],
    n_buckets: int,
    previous: Callable[[Any], Any] = lambda p: p - 1,
) -> DataFrame:
    """:func:`run_periods` into a catalog table whose snapshots are bucketed by key.

    The previous snapshot, the large side of a step, is not shuffled again.
    """
    create_bucketed_snapshots(spark, name, schema, period, keys, n_buckets, path)
    for at in periods:
        prev = spark.table(name).filter(F.col(period) == F.lit(previous(at)))
        overwrite_table(step(prev, at), name)
    return spark.table(name)
