"""Helpers for keys that hold a large share of all rows.

A key counts as hot above a row threshold.  A table of ``r`` rows has fewer
than ``r / threshold`` hot keys, which bounds what is broadcast here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.columns import same_values

HOT_ROWS = 500_000
BROADCAST_ROWS = 500_000
PART_ROWS = 250_000


def parts_for(df: DataFrame, part_rows: int = PART_ROWS) -> int:
    """Number of partitions with which a shuffle of ``df`` has about ``part_rows`` rows in each, and every core has one.

    What a task holds then stays the same however large the input is.  ``df`` is
    counted; a plain scan of Parquet files is counted from their footers.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // part_rows))


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    threshold: int = HOT_ROWS,
    extra: Sequence[Column] = (),
    rows: Column | None = None,
) -> DataFrame:
    """Keys with more than ``threshold`` rows: ``keys``, ``salts``, ``extra``.

    ``salts`` is the number of parts that brings each one near the threshold.
    The count is combined on the map side, so a hot key does not slow it.
    ``rows`` replaces the count of rows, e.g. by one that uses a column which
    the other readers of ``df`` use, so that all share one exchange.
    """
    counted = df.groupBy(*keys).agg((F.count(F.lit(1)) if rows is None else rows).alias("_rows"), *extra)
    return (
        counted.filter(F.col("_rows") > threshold)
        .withColumn("salts", F.ceil(F.col("_rows") / F.lit(threshold)).cast("int"))
        .drop("_rows")
    )


def with_salt(
    df: DataFrame, hot: DataFrame, keys: Sequence[str], by: Sequence[str], name: str = "salt"
) -> DataFrame:
    """Add the part number of each row: 0, or for a hot key a hash of ``by``.

    ``hot`` comes from :func:`hot_keys`; other columns of it are passed on.
    """
    spread = F.pmod(F.xxhash64(*by), F.col("salts").cast("bigint")).cast("int")
    joined = df.alias("l").join(F.broadcast(hot.alias("h")), _same_key(keys), "left")
    passed = [F.col(f"h.{c}").alias(c) for c in hot.columns if c not in (*keys, "salts")]
    salt = F.when(F.col("salts").isNull(), F.lit(0)).otherwise(spread)
    return joined.select("l.*", *passed, salt.alias(name))


def split_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys and rows of hot keys, without a shuffle."""
    left, right = df.alias("l"), F.broadcast(hot.select(*keys).alias("h"))
    return left.join(right, _same_key(keys), "left_anti"), left.join(right, _same_key(keys), "left_semi")


def _same_key(keys: Sequence[str]) -> Column:
    return same_values([F.col(f"l.{k}") for k in keys], [F.col(f"h.{k}") for k in keys])


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows.

    The check reads no more than ``max_rows + 1`` rows; a larger table is
    returned unmarked and joins by shuffle.
    """
    rows = df.limit(max_rows + 1).count()
    return F.broadcast(df) if rows <= max_rows else df


def time_chunks(
    df: DataFrame, key: str, at: str, before: int = 0, after: int = 0, threshold: int = HOT_ROWS
) -> DataFrame:
    """Rows with a ``_chunk`` of time, so that a hot key's windows over ``at`` run in many tasks.

    An ordinary key is one chunk.  A hot key's span is cut into even chunks,
    enough to bring each near the threshold, none shorter than the reach of a
    window.  A row is in its own chunk (``_own``) and, as a halo, in those whose
    windows reach it: ``before`` units back or ``after`` units ahead.  ``at`` is
    a long without NULLs; windows partition by ``key`` and ``_chunk``, and keep
    the rows with ``_own`` afterwards.
    """
    hot = hot_keys(df, [key], threshold, extra=[F.min(at).alias("_from"), F.max(at).alias("_to")])
    span = F.col("_to") - F.col("_from") + 1
    length = F.greatest(F.ceil(span / F.col("salts")).cast("bigint"), F.lit(max(before, after, 1)).cast("bigint"))
    hot = hot.select(key, "_from", length.alias("_length"), F.floor((span - 1) / length).alias("_last"))
    joined = df.alias("l").join(F.broadcast(hot.alias("h")), _same_key([key]), "left")
    chunk = lambda moved: F.floor((F.col(f"l.{at}") + moved - F.col("_from")) / F.col("_length"))
    reached = F.sequence(F.greatest(chunk(-after), F.lit(0)), F.least(chunk(before), F.col("_last")))
    chunks = F.coalesce(reached, F.array(F.lit(0).cast("bigint")))
    own = F.coalesce(chunk(0), F.lit(0).cast("bigint"))
    return joined.select("l.*", own.alias("_home"), F.explode(chunks).alias("_chunk")).withColumn(
        "_own", F.col("_home") == F.col("_chunk")
    ).drop("_home")
