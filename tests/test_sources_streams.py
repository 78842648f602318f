import json
import re
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

import pytest

from tallyglass.functions.skew import broadcast_checked, hot_keys, with_salt
from tallyglass.operators.sessions import sessionize_batch
from tallyglass.session import fresh_path, shared_dir
from tallyglass.sources import files, streams, tables
from tallyglass.streaming.sessionize import sessionize_stream
from tallyglass.streaming.traffic import run_from_files
from tests.conftest import rows_of


def test_csv_with_and_without_schema(spark, tmp_path):
    (tmp_path / "maps.csv").write_text("mapid,size\nx,3\ny,\n")
    path = str(tmp_path / "maps.csv")
    inferred = files.csv_scan(spark, path)
    assert inferred.schema.simpleString() == "struct<mapid:string,size:int>"
    assert rows_of(files.csv_scan(spark, path, "mapid string, size bigint")) == [("x", 3), ("y", None)]


def test_series_views_and_preview(spark, capsys):
    assert rows_of(files.int_series(spark, 1996, 1998)) == [(1996,), (1997,), (1998,)]
    assert [r.date for r in files.date_series(spark, "2023-01-30", "2023-02-01").collect()] == [
        date(2023, 1, 30), date(2023, 1, 31), date(2023, 2, 1),
    ]
    view = files.as_view(files.int_series(spark, 1, 3), "three_numbers")
    assert spark.sql("SELECT sum(value) FROM three_numbers").collect()[0][0] == 6
    assert files.table_scan(spark, "three_numbers").count() == 3
    assert files.preview(view) is view and "value" in capsys.readouterr().out


def test_inserts_bind_by_name(spark):
    path = fresh_path(spark, "t")
    tables.drop_table(spark, "by_name")
    tables.create_table(spark, "by_name", "a int, b string, p int", ["p"], path)
    rows = spark.createDataFrame([("x", 1, 1), ("y", 2, 2)], "b string, p int, a int")
    tables.append_by_name(rows, "by_name")
    assert rows_of(spark.table("by_name"), "a", "b", "p") == [(1, "x", 1), (2, "y", 2)]
    tables.overwrite_table(rows.filter("p = 2").withColumn("b", F.lit("z")), "by_name")
    assert rows_of(spark.table("by_name"), "b", "p") == [("x", 1), ("z", 2)]
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        tables.append_by_name(rows.drop("b"), "by_name")
    tables.drop_table(spark, "by_name")


def test_truncate(spark):
    tables.drop_table(spark, "short_lived")
    spark.range(3).write.saveAsTable("short_lived")
    tables.truncate_table(spark, "short_lived")
    assert spark.table("short_lived").count() == 0
    tables.drop_table(spark, "short_lived")


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "host string, hits int, month string"
    tables.upsert(spark, path, spark.createDataFrame([("a", 1, "jan"), ("b", 1, "jan"), ("a", 9, "feb")], schema), ["host", "month"], ["month"])
    before = {f.name for f in (tmp_path / "t" / "month=feb").iterdir()}
    update = spark.createDataFrame([("a", 2, "jan"), ("c", 3, "jan")], schema)
    for _ in range(2):
        tables.upsert(spark, path, update, ["host", "month"], ["month"])
    got = rows_of(spark.read.parquet(path), "host", "hits", "month")
    assert got == [("a", 2, "jan"), ("a", 9, "feb"), ("b", 1, "jan"), ("c", 3, "jan")]
    assert {f.name for f in (tmp_path / "t" / "month=feb").iterdir()} == before


def test_upsert_reads_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, "jan"), ("a", 9, "feb")], "host string, hits int, month string")
    tables.overwrite_partition(rows, path, ["month"])
    target = spark.read.parquet(path)
    picked = tables._in_partitions_of(target, rows.filter("month = 'jan'"), ["month"])
    # the range of the touched values, or NULL
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", picked._jdf.queryExecution().executedPlan().toString())[1]
    assert "isnull(month" in filters and "jan" in filters
    assert rows_of(picked, "hits") == [(1,)]


@pytest.mark.parametrize("others", [3, 1200])
def test_upsert_keeps_rows_of_a_null_partition(spark, tmp_path, others):
    path = str(tmp_path / "t")
    schema = "id int, month int, v string"
    tables.overwrite_partition(spark.createDataFrame([(1, None, "x"), (2, None, "y")], schema), path, ["month"])
    new = spark.createDataFrame([(1, None, "new")] + [(10 + i, i, "z") for i in range(others)], schema)
    tables.upsert(spark, path, new.repartition(1), ["id", "month"], ["month"])
    got = rows_of(spark.read.schema(schema).parquet(path).filter("month is null"), "id", "v")
    assert got == [(1, "new"), (2, "y")]
    assert spark.read.schema(schema).parquet(path).count() == others + 2


def test_upsert_refuses_repeated_keys_and_leaves_nothing_staged(spark, tmp_path):
    from tallyglass.session import shared_dir

    path, schema = str(tmp_path / "t"), "id int, month int, v string"

    def staged():
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
        system = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(fs)] if system.exists(fs) else []
        return [n for n in names if n.startswith(("arrived", "merged"))]

    tables.upsert(spark, path, spark.createDataFrame([(1, 1, "a")], schema), ["id", "month"], ["month"])
    with pytest.raises(ValueError, match="not unique"):
        tables.upsert(spark, path, spark.createDataFrame([(1, 1, "b"), (1, 1, "c")], schema), ["id", "month"], ["month"])
    assert rows_of(spark.read.schema(schema).parquet(path), "v") == [("a",)]
    assert staged() == []


def test_assert_unique(spark):
    df = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    assert tables.assert_unique(df, ["a", "b"]) is df
    with pytest.raises(ValueError, match="not unique"):
        tables.assert_unique(df, ["a"])


def test_hot_keys_and_salt(spark):
    df = spark.createDataFrame([("hot", i) for i in range(100)] + [("cold", i) for i in range(5)], "k string, v int")
    hot = hot_keys(df, ["k"], 10)
    assert rows_of(hot) == [("hot", 10)]
    salted = with_salt(df, hot, ["k"], ["v"])
    parts = {(r.k, r.salt): r["count"] for r in salted.groupBy("k", "salt").count().collect()}
    assert parts[("cold", 0)] == 5 and len(parts) > 8 and sum(parts.values()) == 105


def test_broadcast_only_below_the_limit(spark):
    big, dim = spark.range(100), spark.range(50)
    plan = lambda d: big.join(d, "id")._jdf.queryExecution().executedPlan().toString()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" in plan(broadcast_checked(dim, 50))
        assert "SortMergeJoin" in plan(broadcast_checked(dim, 49))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_shared_dir_is_stable(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert fresh_path(spark, "a") != fresh_path(spark, "a")


def record(ip, at, host="h.io"):
    stamp = at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"
    return json.dumps({"ip": ip, "event_time": stamp, "referrer": "", "host": host, "url": "/", "geodata": "{}"})


START = datetime(2024, 1, 1, 12)


def at(seconds):
    return START + timedelta(seconds=seconds)


def drain(query):
    query.processAllAvailable()
    query.stop()


def write_batch(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def test_stream_sessions_in_order_of_arrival(spark, tmp_path):
    """Out-of-order rows count, a late row does not, an open session stays out."""
    source = tmp_path / "in"
    source.mkdir()
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    run = lambda: run_from_files(spark, str(source), out, log).awaitTermination()

    write_batch(source, "1.json", [record("a", at(0)), record("a", at(200)), record("a", at(190)), record("a", at(0), "other.io"), "not json"])
    run()
    # Exactly one gap after the last event joins the session; 1000 s moves the watermark on.
    write_batch(source, "2.json", [record("a", at(500)), record("b", at(1000))])
    run()
    got = rows_of(spark.read.parquet(out), "event_hour", "ip", "host", "num_hits")
    assert got == [(at(0), "a", "h.io", 4), (at(0), "a", "other.io", 1)]
    # Older than the watermark and outside every open session: dropped.
    write_batch(source, "3.json", [record("c", at(100)), record("b", at(2000))])
    run()
    got = rows_of(spark.read.parquet(out), "event_hour", "ip", "num_hits")
    assert (at(1000), "b", 1) in got and not [r for r in got if r[1] == "c"] and len(got) == 3


def test_stream_equals_batch_but_for_open_sessions(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    events = [(f"ip{i % 7}", at(i * 37 + (i % 5) * 11)) for i in range(400)]
    write_batch(source, "1.json", [record(*e) for e in events])
    out = str(tmp_path / "out")
    run_from_files(spark, str(source), out, str(tmp_path / "log"), gap="60 seconds").awaitTermination()
    df = spark.createDataFrame([(ip, "h.io", t) for ip, t in events], "ip string, host string, ts timestamp")
    batch = sessionize_batch(df, ["ip", "host"], "ts", 60)
    watermark = max(t for _, t in events) - timedelta(seconds=15)
    closed = batch.filter(F.col("session_last") + F.expr("INTERVAL 60 SECONDS") <= F.lit(watermark))
    expected = rows_of(closed.select("session_start", "ip", "host", "num_hits"))
    assert rows_of(spark.read.parquet(out), "event_hour", "ip", "host", "num_hits") == expected
    assert 0 < len(expected) < batch.count()


def test_restart_from_the_checkpoint_repeats_nothing(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    write_batch(source, "1.json", [record("a", at(0)), record("b", at(5000))])
    for _ in range(2):
        run_from_files(spark, str(source), out, log).awaitTermination()
    assert rows_of(spark.read.parquet(out), "ip", "num_hits") == [("a", 1)]


def test_upsert_sink_is_repeatable(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_batch(source, "1.json", [record("a", at(0)), record("b", at(5000))])
    target = str(tmp_path / "table")
    keys = ["event_hour", "ip", "host", "day"]
    for attempt in ("first", "again"):  # a lost checkpoint replays the batch
        stream = sessionize_stream(streams.parse_traffic(streams.text_stream(spark, str(source), 1)))
        daily = stream.withColumn("day", F.to_date("event_hour"))
        streams.write_upsert_stream(daily, target, keys, ["day"], str(tmp_path / attempt), every=None).awaitTermination()
    assert rows_of(spark.read.parquet(target), "ip", "num_hits") == [("a", 1)]


def test_connectors_without_their_jars_say_so(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        streams.kafka_stream(spark, "localhost:1", "t", "key", "secret")


def test_dates_outside_the_pattern_become_null(spark):
    raw = spark.createDataFrame([(json.dumps({"ip": "a", "event_time": "yesterday", "host": "h"}),)], "value string")
    assert streams.parse_traffic(raw).select("window_timestamp").collect()[0][0] is None
