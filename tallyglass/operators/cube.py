"""Several groupings in one pass, with label rows, and top rows of the result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.operators.profile import top_one


def grouping_sets_cube(
    df: DataFrame,
    sets: Sequence[Sequence[str]],
    measures: Mapping[str, Column],
    labels: Mapping[str, str],
) -> DataFrame:
    """Aggregate over each grouping set; columns outside a set carry their label.

    Labels follow ``grouping()``, so a real NULL stays NULL.  ``labels`` names
    all grouping columns, which come out as strings.
    """
    columns = list(labels)
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    flags = [F.grouping(c).alias(f"_g_{c}") for c in columns]
    result = grouped.agg(*[m.alias(name) for name, m in measures.items()], *flags)
    return result.select(
        *[
            F.when(F.col(f"_g_{c}") == 1, F.lit(label)).otherwise(F.col(c).cast("string")).alias(c)
            for c, label in labels.items()
        ],
        *measures,
    )


def grouped_top(
    df: DataFrame, per: Sequence[str], measure: Column, name: str
) -> DataFrame:
    """Top row of one grouping, aggregated on its own.

    The same row as :func:`cube_top` gives for the set ``per``, without the work of the other sets.
    """
    keys = [F.col(c).cast("string").alias(c) for c in per]
    return top_one(df.groupBy(*per).agg(measure.alias(name)).select(*keys, name), name, list(per))


def cube_top(
    cube: DataFrame, labels: Mapping[str, str], per: Sequence[str], measure: str
) -> DataFrame:
    """Top row of one grouping set of the cube.

    Rows of the set have the label in every column outside ``per`` and
    something else in the columns of ``per``.
    """
    rows = cube
    for column, label in labels.items():
        same = F.col(column).eqNullSafe(F.lit(label))
        rows = rows.filter(~same if column in per else same)
    return top_one(rows.select(*per, measure), measure, list(per))
