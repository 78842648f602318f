"""Small exploratory queries over fact and dimension tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def date_range(df: DataFrame, ts: str) -> DataFrame:
    """First and last date of a timestamp column."""
    return df.agg(F.to_date(F.min(ts)).alias("first_date"), F.to_date(F.max(ts)).alias("last_date"))


def count_by(df: DataFrame, keys: Sequence[str], sort: bool = True) -> DataFrame:
    """Rows per key combination, most frequent first."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.orderBy(F.col("row_count").desc(), *keys) if sort else counted


def rows_with_key_count(df: DataFrame, keys: Sequence[str], times: int) -> DataFrame:
    """Rows whose key occurs exactly ``times`` times."""
    wanted = df.groupBy(*keys).count().filter(F.col("count") == times).select(*keys)
    return df.join(wanted, list(keys), "left_semi")


def length_histogram(df: DataFrame, array: str) -> DataFrame:
    """Rows per array length."""
    return df.groupBy(F.size(array).alias("array_length")).agg(F.count(F.lit(1)).alias("row_count"))


def joined_duplicates(
    joined: DataFrame, keys: Sequence[str], user_key: str | None = "user_id", minimum: int = 1
) -> DataFrame:
    """Rows per key after a join, known users only, most repeated first."""
    rows = joined if user_key is None else joined.filter(F.col(user_key).isNotNull())
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
    return counted.filter(F.col("cnt") >= minimum)


def top_one(df: DataFrame, measure: str, ties: Sequence[str]) -> DataFrame:
    """The row with the largest ``measure``; ``ties`` decide between equals."""
    return df.orderBy(F.col(measure).desc_nulls_last(), *ties).limit(1)


def count_distinct_by(df: DataFrame, keys: Sequence[str], what: Column, name: str) -> DataFrame:
    """Distinct ``what`` per key combination."""
    return df.groupBy(*keys).agg(F.count_distinct(what).alias(name))
