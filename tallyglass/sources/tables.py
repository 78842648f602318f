"""Table writes: append, overwrite, upsert, bucketing, key checks."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions.columns import same_values
from tallyglass.session import fresh_path


def create_table(spark: SparkSession, name: str, ddl: str, partition_by: Sequence[str] = (), path: str | None = None) -> None:
    """Create a parquet table from a column list."""
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    location = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet{parts}{location}")


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def truncate_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")


def _in_table_order(df: DataFrame, table: str) -> DataFrame:
    return df.select(*df.sparkSession.table(table).columns)


def append_by_name(df: DataFrame, table: str) -> None:
    """Insert rows, matching columns by name; a missing column fails."""
    _in_table_order(df, table).write.mode("append").insertInto(table)


def overwrite_table(df: DataFrame, table: str) -> None:
    """Replace the rows of an existing table, matching columns by name.

    In a partitioned table only the partitions present in ``df`` are replaced.
    """
    ordered = _in_table_order(df, table)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(table)


def overwrite_partition(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Write parquet, replacing only the partitions present in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def _file_system(spark: SparkSession, path: str):
    """The path and its file system, whichever that is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``."""
    target, system = _file_system(spark, path)
    return system.exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a staged folder."""
    target, system = _file_system(spark, path)
    system.delete(target, True)


def _in_partitions_of(target: DataFrame, rows: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of ``target`` in the partitions ``rows`` has; two NULL partition values are equal.

    The range of the touched values goes into the scan, so folders outside it are not read.
    """
    ends = rows.agg(*[f(c).alias(f"{n}_{c}") for c in partition_by for n, f in (("min", F.min), ("max", F.max))]).first()
    for c in partition_by:
        inside = F.col(c).isNull()
        if ends[f"min_{c}"] is not None:
            inside |= F.col(c).between(F.lit(ends[f"min_{c}"]), F.lit(ends[f"max_{c}"]))
        target = target.filter(inside)
    old, new = target.alias("old"), rows.select(*partition_by).distinct().alias("new")
    match = same_values([F.col(f"old.{c}") for c in partition_by], [F.col(f"new.{c}") for c in partition_by])
    return old.join(new, match, "left_semi")


def upsert(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], partition_by: Sequence[str]) -> None:
    """Replace or add rows of a partitioned parquet table by key.

    Only partitions ``source`` touches are written.  ``source`` is evaluated
    once, into the shared folder; the merged rows are staged there too, since a
    plan cannot overwrite what it reads, and both are removed after the commit.
    ``keys`` include the partition columns; a key that ``source`` holds twice
    fails the write before anything is changed.  A missing table is created.
    """
    arrived, merged = fresh_path(spark, "arrived"), fresh_path(spark, "merged")
    try:
        source.write.parquet(arrived)
        incoming = spark.read.schema(source.schema).parquet(arrived)
        assert_unique(incoming, keys)
        if not path_exists(spark, path):
            overwrite_partition(incoming, path, partition_by)
            return
        target = spark.read.schema(source.schema).parquet(path)
        affected = _in_partitions_of(target, incoming, partition_by).alias("old")
        match = same_values([F.col(f"old.{k}") for k in keys], [F.col(f"new.{k}") for k in keys])
        untouched = affected.join(incoming.select(*keys).alias("new"), match, "left_anti")
        untouched.unionByName(incoming).write.parquet(merged)
        overwrite_partition(spark.read.schema(source.schema).parquet(merged), path, partition_by)
    finally:
        for staged in (arrived, merged):
            remove_path(spark, staged)


def create_bucketed_snapshots(
    spark: SparkSession, name: str, schema: T.StructType, period: str, keys: Sequence[str], n_buckets: int, path: str
) -> None:
    """Create a table partitioned by period, each partition bucketed and sorted by key.

    A step that joins the last snapshot on its key then reads it in place and
    shuffles the new rows only.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(keys)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({period}) "
        f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n_buckets} BUCKETS LOCATION '{path}'"
    )


def write_bucketed(
    spark: SparkSession,
    df: DataFrame,
    name: str,
    n_buckets: int,
    keys: Sequence[str],
    sort_by: Sequence[str] | None = None,
) -> DataFrame:
    """Write ``df`` as a bucketed, sorted table in the shared folder and return its scan.

    Rows are sent to their bucket's task first, so each bucket is one file.
    The catalog entry goes once the scan is resolved; the files stay in the
    shared folder for the scan.
    """
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    (
        df.repartition(n_buckets, *keys)
        .write.mode("overwrite")
        .format("parquet")
        .option("path", fresh_path(spark, name))
        .bucketBy(n_buckets, *keys)
        .sortBy(*(sort_by or keys))
        .saveAsTable(table)
    )
    stored = spark.table(table)
    stored.columns  # noqa: B018 - resolves the table before its entry goes
    drop_table(spark, table)
    return stored


def keep_bucketed(
    df: DataFrame, table: str, n_buckets: int, keys: Sequence[str], sort_by: Sequence[str] | None = None, path: str | None = None
) -> DataFrame:
    """``df`` as a bucketed, sorted table that stays in the catalog; a table that is there already is left as it is.

    Rows are sent to their bucket's task first, so each bucket is one file.  The entry appears once all files are written.
    ``path`` keeps the files outside the warehouse folder.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        writer = df.repartition(n_buckets, *keys).write.format("parquet").bucketBy(n_buckets, *keys).sortBy(*(sort_by or keys))
        (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


def bucketing_of(spark: SparkSession, table: str) -> tuple[int, list[str]]:
    """Number of buckets and bucket columns of a catalog table, in order."""
    found = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    if "Num Buckets" not in found:
        raise ValueError(f"{table} is not bucketed")
    columns = found["Bucket Columns"].strip("[]").split(",")
    return int(found["Num Buckets"]), [c.strip().strip("`") for c in columns]


def append_bucketed(df: DataFrame, table: str) -> None:
    """Append rows to a bucketed table, matching columns by name; each bucket gets one more file."""
    n_buckets, keys = bucketing_of(df.sparkSession, table)
    append_by_name(df.repartition(n_buckets, *keys), table)


def files_mark(spark: SparkSession, paths: Sequence[str]) -> str:
    """A short text that changes when the files under the paths do: a hash of their names, sizes and times."""
    entries = []
    for path in paths:
        target, system = _file_system(spark, path)
        files = system.listFiles(target, True)
        while files.hasNext():
            status = files.next()
            entries.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(entries)).encode()).hexdigest()[:16]


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df``, or an error if a key occurs more than once."""
    repeated = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).collect()
    if repeated:
        raise ValueError(f"key {tuple(keys)} is not unique, e.g. {repeated[0]}")
    return df
