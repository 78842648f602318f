"""Ordered calculations per key that also hold for one very large key.

A plain window per key puts a key's rows into one task.  That is the cheapest
plan for ordinary keys and is kept for them.  Keys above a row threshold are
range-partitioned on key and order instead, which cuts each into even chunks;
windows run inside a chunk, and each chunk is reduced to one small row that is
combined with its key's other chunks.  If no key is that large, the second
branch is empty and Spark drops it at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions.skew import HOT_ROWS, hot_keys, split_hot


def _chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Number the range partitions; a later chunk of a key holds later rows."""
    ranges = df.repartitionByRange(parts, *keys, *order) if parts else df.repartitionByRange(*keys, *order)
    return _dealt(ranges.withColumn("_chunk", F.spark_partition_id()), [*keys, "_chunk"], parts)


def _dealt(df: DataFrame, keys: Sequence[str], parts: int | None) -> DataFrame:
    """``df`` in ``parts`` partitions by key, if given, for the window that follows."""
    return df.repartition(parts, *keys) if parts else df


def _so_far(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _misses_so_far(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A run of hits is named by the number of misses before it."""
    misses = F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(_so_far(keys, order))
    return rows.withColumn("_run", misses)


def longest_streak(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    pred: Column,
    name: str = "longest_streak",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Longest run of consecutive rows passing ``pred``, per key.

    ``order`` should be unique within a key.  A NULL predicate breaks the run;
    a key without a passing row gets NULL.
    """
    rows = df.select(*keys, *order, F.coalesce(pred, F.lit(False)).alias("_hit"))
    cold, hot = split_hot(rows, hot_keys(rows, keys, hot_rows), keys)
    cold_runs = _misses_so_far(cold, keys, order).groupBy(*keys, "_run").agg(F.count_if("_hit").alias("_n"))
    best = F.max("_n")
    of_cold = cold_runs.groupBy(*keys).agg(F.when(best > 0, best).alias(name))
    return of_cold.unionByName(_longest_streak_chunked(hot, keys, order, name))


def _longest_streak_chunked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    in_chunk = [*keys, "_chunk"]
    runs = _misses_so_far(_chunked(rows, keys, order), in_chunk, order).groupBy(*in_chunk, "_run").agg(
        F.count_if("_hit").alias("_n")
    )
    chunks = runs.groupBy(*in_chunk).agg(
        F.max("_run").alias("_misses"),
        F.max("_n").alias("_best"),
        F.sum(F.when(F.col("_run") == 0, F.col("_n")).otherwise(0)).alias("_head"),
        F.max_by("_n", "_run").alias("_tail"),
    )
    # Across chunks a run is named by all misses of the key before it: a
    # chunk's head continues the run before it, its tail opens the last one.
    placed = chunks.withColumn("_through", F.sum("_misses").over(_so_far(keys, ["_chunk"])))

    def piece(run: Column, n: str) -> Column:
        return F.struct(run.alias("_run"), F.col(n).alias("_n"))

    head = piece(F.col("_through") - F.col("_misses"), "_head")
    pieces = F.when(F.col("_misses") == 0, F.array(head)).otherwise(F.array(head, piece(F.col("_through"), "_tail")))
    joined = placed.select(*keys, "_best", F.inline(pieces)).groupBy(*keys, "_run").agg(
        F.sum("_n").alias("_n"), F.max("_best").alias("_best")
    )
    best = F.max(F.greatest("_n", "_best"))
    return joined.groupBy(*keys).agg(F.when(best > 0, best).alias(name))


def rolling_sum_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    n: int,
    name: str,
    hot_rows: int = HOT_ROWS,
    parts: int | None = None,
) -> DataFrame:
    """Largest sum of ``value`` over any ``n`` consecutive rows, per key.

    Frames at a key's start hold fewer rows, as ``ROWS n-1 PRECEDING`` gives.
    ``order`` should be unique within a key and ``value`` an integer.
    ``parts`` is the number of partitions of each shuffle of rows, e.g. from
    :func:`parts_for`; without it the session decides.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(*keys, *order, value.cast("bigint").alias("_v"))
    # Counted through the value: if ``df`` is an aggregate, it runs once for all branches.
    counted = F.count("_v") + F.count_if(F.col("_v").isNull())
    cold, hot = split_hot(rows, hot_keys(rows, keys, hot_rows, rows=counted), keys)
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    sums = _dealt(cold, keys, parts).withColumn("_sum", F.sum("_v").over(frame))
    of_cold = sums.groupBy(*keys).agg(F.max("_sum").alias(name))
    return of_cold.unionByName(_rolling_sum_max_chunked(hot, keys, order, n, name, parts))


def _rolling_sum_max_chunked(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, name: str, parts: int | None = None
) -> DataFrame:
    """A chunk passes on its first and last ``n - 1`` values for the frames that cross its borders."""
    in_chunk = [*keys, "_chunk"]
    group = Window.partitionBy(*in_chunk)
    inside = group.orderBy(*order)
    numbered = (
        _chunked(rows, keys, order, parts)
        .withColumn("_i", F.row_number().over(inside))
        .withColumn("_sum", F.sum("_v").over(inside.rowsBetween(1 - n, 0)))
        .withColumn("_size", F.count(F.lit(1)).over(group))
    )
    pair = F.struct("_i", F.coalesce("_v", F.lit(0).cast("bigint")).alias("_v"))

    def values(which: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(which, pair)))["_v"]

    chunks = numbered.groupBy(*in_chunk).agg(
        F.max("_sum").alias("_alone"),
        F.max(F.when(F.col("_i") >= n, F.col("_sum"))).alias("_inner"),
        values(F.col("_i") < n).alias("_head"),
        values(F.col("_size") - F.col("_i") < n - 1).alias("_tail"),
    )
    # The n - 1 chunks before hold at least the n - 1 values before.
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = F.flatten(F.collect_list("_tail").over(by_chunk.rowsBetween(1 - n, -1))) if n > 1 else F.col("_tail")
    halo = F.slice(earlier, F.greatest(F.size(earlier) - (n - 2), F.lit(1)), F.lit(max(n - 1, 1)))
    lined = chunks.withColumn("_halo", halo)

    before = F.size("_halo")
    line = F.concat("_halo", "_head")

    def frame_sum(i: Column) -> Column:
        start = F.greatest(before + i - (n - 1), F.lit(1))
        return F.aggregate(
            F.slice(line, start, before + i - start + 1), F.lit(0).cast("bigint"), lambda acc, x: acc + x
        )

    crossing = F.array_max(F.transform(F.sequence(F.lit(1), F.size("_head")), frame_sum))
    best = F.when(before == 0, F.col("_alone")).otherwise(F.greatest("_inner", crossing))
    return lined.groupBy(*keys).agg(F.max(best).alias(name))


def rolling_wins_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], won: str, n: int = 90,
    name: str = "most_wins_in_stretch", hot_rows: int = HOT_ROWS, parts: int | None = None,
) -> DataFrame:
    """Most wins in any ``n`` consecutive games over all keys, as one row.

    A game is one (key, order) value, however many rows it has; it is won if
    any of them says so.  Games are grouped where ``df`` has them if it comes
    partitioned by some of these columns; ``parts`` is as in
    :func:`rolling_sum_max`.
    """
    games = df.groupBy(*keys, *order).agg(F.max(won).alias(won))
    per_key = rolling_sum_max(games, keys, order, F.col(won), n, name, hot_rows, parts)
    return per_key.agg(F.max(name).alias(name))
