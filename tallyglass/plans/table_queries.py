"""Reads and writes of tables, over whole test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.plans.registry import query
from tallyglass.session import fresh_path
from tallyglass.sources.bindings import Tables
from tallyglass.sources.files import as_view, csv_scan
from tallyglass.sources.tables import (
    append_by_name,
    create_table,
    drop_table,
    overwrite_partition,
    overwrite_table,
    upsert,
)

SEGMENTS = ["c_custkey", "c_acctbal", "c_mktsegment"]


@query(
    "csv_scan",
    """SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate,
              o_orderpriority FROM orders""",
)
def q_csv(t: Tables):
    path = fresh_path(t.spark, "orders-csv")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    rows = t.orders.withColumn("o_orderstatus", status).withColumn("o_orderdate", F.to_date("o_orderdate"))
    rows.select(*columns).write.csv(path, header=True)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"
    return csv_scan(t.spark, path, schema)


def _insert(t: Tables, *writes):
    """A fresh table of customers filled by ``writes``, read back and dropped from the catalog."""
    path = fresh_path(t.spark, "customers")
    name = "customers_" + path[-12:]
    create_table(t.spark, name, "c_acctbal double, c_custkey bigint, c_mktsegment string", ["c_mktsegment"], path)
    for write in writes:
        write(t.customer.select(*SEGMENTS), name)
    drop_table(t.spark, name)
    return t.spark.read.schema("c_acctbal double, c_custkey bigint, c_mktsegment string").parquet(path)


@query("append_by_name", "SELECT c_acctbal, c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_acctbal, c_custkey, c_mktsegment FROM customer")
def q_append(t: Tables):
    return _insert(t, append_by_name, append_by_name)


@query("overwrite_table", "SELECT c_acctbal, c_custkey, c_mktsegment FROM customer")
def q_overwrite(t: Tables):
    return _insert(t, append_by_name, overwrite_table)


@query(
    "overwrite_partition",
    """SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal
    FROM customer""",
)
def q_partition(t: Tables):
    path = fresh_path(t.spark, "segments")
    rows = t.customer.select(*SEGMENTS)
    overwrite_partition(rows, path, ["c_mktsegment"])
    changed = rows.filter(F.col("c_mktsegment") == "BUILDING").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    overwrite_partition(changed, path, ["c_mktsegment"])
    return t.spark.read.schema("c_custkey bigint, c_acctbal double, c_mktsegment string").parquet(path)


@query(
    "upsert",
    """SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal
    FROM customer""",
)
def q_upsert(t: Tables):
    path = fresh_path(t.spark, "segments")
    rows = t.customer.select(*SEGMENTS)
    overwrite_partition(rows, path, ["c_mktsegment"])
    in_debt = rows.filter((F.col("c_acctbal") < 0) & (F.col("c_mktsegment") == "BUILDING"))
    upsert(t.spark, path, in_debt.withColumn("c_acctbal", F.lit(0.0)), ["c_custkey", "c_mktsegment"], ["c_mktsegment"])
    return t.spark.read.schema("c_custkey bigint, c_acctbal double, c_mktsegment string").parquet(path)


@query(
    "upsert_many_partitions",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) // 2 END AS two_days,
              CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice
    FROM orders""",
)
def q_upsert_many(t: Tables):
    """A third of the orders upserted into a table partitioned by pairs of days, orders in progress in the NULL partition."""
    path = fresh_path(t.spark, "orders-by-days")
    days = F.expr("cast(datediff(o_orderdate, date '1995-01-01') div 2 as int)")
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", days).alias("two_days"), "o_totalprice")
    # dealt by partition value, so that each is one file
    overwrite_partition(rows.repartition("two_days"), path, ["two_days"])
    changed = rows.filter(F.col("o_orderkey") % 3 == 0).withColumn("o_totalprice", -F.col("o_totalprice"))
    upsert(t.spark, path, changed, ["o_orderkey", "two_days"], ["two_days"])
    return t.spark.read.schema(rows.schema).parquet(path)


@query(
    "view_over_frame",
    """SELECT c_mktsegment, count(*) AS order_count FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""",
)
def q_view(t: Tables):
    views = {name: f"{name}_{fresh_path(t.spark, name)[-12:]}" for name in ("order_rows", "customer_rows")}
    as_view(t.orders, views["order_rows"])
    as_view(t.customer, views["customer_rows"])
    counted = t.spark.sql(
        f"""SELECT c_mktsegment, count(*) AS order_count FROM {views["order_rows"]}
        JOIN {views["customer_rows"]} ON c_custkey = o_custkey GROUP BY c_mktsegment"""
    )
    for view in views.values():
        t.spark.catalog.dropTempView(view)
    return counted
