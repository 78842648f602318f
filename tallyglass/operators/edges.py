"""Graph edges from fact rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.operators.dedup import dedup_keep_one


def build_edges(
    df: DataFrame,
    subject: str,
    obj: str,
    edge_type: str,
    props: Sequence[str],
    order_by: Sequence[str | Column],
    subject_type: str,
    object_type: str,
) -> DataFrame:
    """One edge per subject and object, its properties as a string map.

    ``order_by`` picks the row the properties come from.
    """
    unique = dedup_keep_one(df, [subject, obj], order_by)
    entries = [e for p in props for e in (F.lit(p), F.col(p).cast("string"))]
    return unique.select(
        F.col(subject).alias("subject_identifier"),
        F.lit(subject_type).alias("subject_type"),
        F.col(obj).alias("object_identifier"),
        F.lit(object_type).alias("object_type"),
        F.lit(edge_type).alias("edge_type"),
        F.create_map(*entries).alias("properties"),
    )
