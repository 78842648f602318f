"""Joins of snapshots with new rows in which NULL keys match each other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions.columns import same_values


def _some_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def full_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bucketed: bool = False) -> DataFrame:
    """Full outer join on ``keys``, two NULLs being equal; the keys come out once, then both sides' other columns.

    With ``bucketed`` complete keys are joined by plain equality, so a side that is stored bucketed by them is read in
    place, and the rows with a NULL in their key are joined apart.  That names each side twice, so it is for sides that
    are stored; the rows are the same either way.  Each side holds at most one row per key.
    """
    if not bucketed:
        return _null_safe(left, right, keys)
    whole = left.filter(~_some_null(keys)).join(right.filter(~_some_null(keys)), list(keys), "full")
    return whole.unionByName(_null_safe(left.filter(_some_null(keys)), right.filter(_some_null(keys)), keys))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    a, b = left.alias("a"), right.alias("b")
    return a.join(b, same_values([F.col(f"a.{k}") for k in keys], [F.col(f"b.{k}") for k in keys]), "full").select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys],
        *[F.col(f"a.{c}") for c in left.columns if c not in keys],
        *[F.col(f"b.{c}") for c in right.columns if c not in keys],
    )
