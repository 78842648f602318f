"""Joins of points with the intervals they lie in, by bins of the ordered column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.skew import HOT_ROWS, hot_keys, with_salt


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    point: str,
    low: str | None,
    high: str | None,
    width: float,
    keys: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Pairs of a row of ``points`` and one of ``intervals`` with ``low <= point < high``, and equal ``keys``.

    ``low`` or ``high`` of None is an open end; the columns are numbers (times as microseconds), and a NULL in one of them
    joins nothing.  The column is cut into bins of ``width``; a point is in one bin, an interval in all it overlaps that lie
    between the first and the last point, and the sides join by bin.  A width near a usual interval's length gives an
    interval two bins or so.  A bin with more than ``hot_rows`` points is dealt into parts by a hash of its rows, and the
    intervals in it go to every part.  Columns of the two sides other than ``keys`` must differ in name.
    """
    bin_of = lambda column: F.floor(column / F.lit(width)).cast("bigint")
    left = points.withColumn("_bin", bin_of(F.col(point))).filter("_bin is not null")
    hot = hot_keys(left, ["_bin"], hot_rows)
    left = with_salt(left, hot, ["_bin"], by=points.columns, name="_part")
    ends = points.agg(F.struct(bin_of(F.min(point)).alias("least"), bin_of(F.max(point)).alias("most"))).scalar()
    right = intervals.withColumn("_ends", ends)
    for column in (low, high):
        if column is not None:
            right = right.filter(F.col(column).isNotNull())
    first = F.col("_ends.least") if low is None else F.greatest(bin_of(F.col(low)), "_ends.least")
    last = F.col("_ends.most") if high is None else F.least(bin_of(F.col(high)), "_ends.most")
    right = right.withColumn("_from", first).withColumn("_to", last).filter("_ends.least is not null and _from <= _to")
    right = right.select(*intervals.columns, F.explode(F.sequence("_from", "_to")).alias("_bin"))
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("_part")
    right = right.join(F.broadcast(hot), "_bin", "left").select(*intervals.columns, "_bin", parts)
    joined = left.join(right, [*keys, "_bin", "_part"])
    if low is not None:
        joined = joined.filter(F.col(low) <= F.col(point))
    if high is not None:
        joined = joined.filter(F.col(point) < F.col(high))
    return joined.drop("_bin", "_part")
