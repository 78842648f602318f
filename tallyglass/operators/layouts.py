"""File layouts for data skipping: Z-order, and what a filter must read of each layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.session import fresh_path


def _reached_by(column: str):
    return lambda edge: edge <= F.col(column)


def z_value(df: DataFrame, columns: Sequence[str], bits: int = 6, error: float = 0.002) -> Column:
    """The columns' range ranks with their bits interleaved, the first column's highest bit on top.

    A rank is the number of a value's range among ``2 ** bits`` of about equal rows, from approximate quantiles: one pass over
    the columns.  Frequent values make ranges equal, which only leaves ranks out.  NULL ranks lowest.
    """
    probabilities = [i / 2**bits for i in range(1, 2**bits)]
    value = F.lit(0).cast("bigint")
    for i, (column, bounds) in enumerate(zip(columns, df.approxQuantile(list(columns), probabilities, error), strict=True)):
        edges = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<double>")
        rank = F.coalesce(F.size(F.filter(edges, _reached_by(column))), F.lit(0))
        for bit in range(bits):
            place = bit * len(columns) + (len(columns) - 1 - i)
            set_bit = F.shiftright(rank, bit).bitwiseAND(1).cast("bigint")
            value = value + F.shiftleft(set_bit, place)
    return value


def write_layout(df: DataFrame, order: Sequence[str | Column], n_files: int, label: str = "layout") -> str:
    """``df`` in ``n_files`` files by ranges of ``order``, sorted inside each; the folder's path."""
    path = fresh_path(df.sparkSession, label)
    placed = df.repartitionByRange(n_files, *order).sortWithinPartitions(*order) if order else df.repartition(n_files)
    placed.write.parquet(path)
    return path


def file_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value of each column per file of a scan, and the file's rows: one row per file."""
    ends = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("row_count"), *ends)


def files_read(ranges: DataFrame, wanted: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Per column, the files whose range a filter between two values meets, of how many: ``column_name``, ``files``, ``files_read``."""
    total = F.count(F.lit(1))
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            total.alias("files"),
            F.count_if((F.col(f"max_{c}") >= low) & (F.col(f"min_{c}") <= high)).alias("files_read"),
        )
        for c, (low, high) in wanted.items()
    ]
    return ranges.agg(F.array(*entries).alias("_e")).select(F.inline("_e"))


def layout_skipping(
    df: DataFrame, layouts: Mapping[str, Sequence[str | Column]], n_files: int, wanted: Mapping[str, tuple[float, float]]
) -> DataFrame:
    """Write ``df`` once per layout and report, per column of ``wanted``, how many files a filter on it must read."""
    spark, out = df.sparkSession, None
    for name, order in layouts.items():
        path = write_layout(df, order, n_files, f"layout-{name}")
        ranges = file_ranges(spark.read.schema(df.schema).parquet(path), list(wanted))
        report = files_read(ranges, wanted).select(F.lit(name).alias("layout"), "*")
        out = report if out is None else out.unionByName(report)
    return out
