"""Bucketed tables that stay, and the account of a stream with late events."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyglass.operators.bucketed import kept_fact_join
from tallyglass.session import fresh_path
from tallyglass.sources.tables import append_bucketed, bucketing_of, drop_table, files_mark, keep_bucketed
from tallyglass.streaming import late


@pytest.fixture
def tables(spark):
    names = ["kept_left", "kept_right"]
    left = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("a"))
    right = spark.range(0, 300, 3).select(F.col("id").alias("k"), (F.col("id") + 1).alias("b"))
    for name, frame in zip(names, (left, right), strict=True):
        drop_table(spark, name)
        keep_bucketed(frame, name, 6, ["k"], path=fresh_path(spark, name))
    yield names
    for name in names:
        drop_table(spark, name)


def test_kept_tables_join_in_place_also_after_appends(spark, tables):
    left, right = tables
    append_bucketed(spark.createDataFrame([(7, 300), (8, 400)], "a bigint, k bigint"), left)
    append_bucketed(spark.createDataFrame([(300, 5)], "k bigint, b bigint"), right)
    joined = kept_fact_join([spark.table(left), spark.table(right)], ["k"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
    found = sorted(tuple(r) for r in joined.select("k", "a", "b").collect())
    assert found == [(k, 2 * k, k + 1) for k in range(0, 100, 3)] + [(300, 7, 5)]
    assert bucketing_of(spark, left) == (6, ["k"])


def test_a_kept_table_is_written_once(spark, tables):
    again = keep_bucketed(spark.range(5).select(F.col("id").alias("k"), F.lit(0).cast("bigint").alias("a")), tables[0], 3, ["k"])
    assert again.count() == 100 and bucketing_of(spark, tables[0])[0] == 6


def test_a_key_filter_reads_one_bucket(spark, tables):
    picked = kept_fact_join([spark.table(name).filter("k = 42") for name in tables], ["k"])
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SelectedBucketsCount: 1 out of 6") == 2
    assert [tuple(r) for r in picked.collect()] == [(42, 84, 43)]


def test_the_mark_changes_with_the_files(spark):
    path = fresh_path(spark, "marked")
    spark.range(3).write.parquet(path)
    before = files_mark(spark, [path])
    assert files_mark(spark, [path]) == before
    spark.range(2).write.mode("append").parquet(path)
    assert files_mark(spark, [path]) != before


def line(ip, seconds, host="h"):
    time = None if seconds is None else (datetime(2024, 1, 1) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    return json.dumps({"ip": ip, "host": host, "event_time": time})


def test_events_read_are_late_closed_or_open(spark):
    source, folder = fresh_path(spark, "in"), fresh_path(spark, "counted")
    arrivals = [
        [line("a", 0), line("a", 50), line("b", 1000), "not json"],
        # the watermark is 985: a session of 60 s that starts at 925 or before is late
        [line("a", 925), line("c", 926), line("a", 400), line("a", None), line("b", 1050)],
        [line("d", 100_000)],
        [line("a", 5), line("e", 99_990)],
    ]
    for lines in arrivals:
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(source)
        late.run_counted(spark, source, folder, 60)
    batches = sorted((r["batch_id"], r["events_read"], r["late_events"], r["untimed_events"]) for r in late.account(spark, folder).collect())
    assert batches == [(0, 4, 0, 1), (1, 5, 2, 1), (2, 1, 0, 0), (3, 2, 1, 0)]
    (row,) = late.balance(spark, folder).collect()
    assert row.asDict() == {"events_read": 12, "late_events": 3, "untimed_events": 2, "closed_hits": 5, "open_hits": 2, "agrees": True}
    columns = late.rows_of_kind(spark, folder, spark.read.parquet(f"{folder}/rows").drop("batch", "kind").schema, "late")
    assert sorted(r["window_timestamp"].second for r in columns.collect()) == [5, 25, 40]
    closed = sorted((r["ip"], r["num_hits"]) for r in late.closed_sessions(spark, folder).collect())
    assert closed == [("a", 2), ("b", 2), ("c", 1)]


def test_a_batch_split_again_gives_the_same(spark):
    source, folder = fresh_path(spark, "in"), fresh_path(spark, "counted")
    for lines in ([line("a", 0), line("b", 500)], [line("a", 10), line("b", 520)]):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(source)
        late.run_counted(spark, source, folder, 60)
    before = sorted(tuple(r) for r in late.account(spark, folder).collect())
    # a second split of the same source, as after a crash that lost the query's own log of batches done
    events = late.parse_traffic(late.text_stream(spark, source, files_per_trigger=1))
    late.split_late(events, "window_timestamp", 60, 15, folder, fresh_path(spark, "log")).awaitTermination()
    after = sorted(tuple(r) for r in late.account(spark, folder).collect())
    assert [r[:4] for r in after] == [r[:4] for r in before] and sum(r[1] for r in after) == 4


def test_nothing_has_arrived(spark):
    folder = fresh_path(spark, "counted")
    assert late.account(spark, folder).collect() == [] and late.closed_sessions(spark, folder).collect() == []
