"""Run a registered query and its SQL twin and compare the rows.

``python -m tests.compare SF_DIR [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

VIEWS = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for view in VIEWS:
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{sf_dir}/{view}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (bool, str, int, float)) or value is None:
        return (type(value).__name__, value)
    return (type(value).__name__, str(value))


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(v) for v in row) for row in df.select(*names).collect())


def oracle_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = Counter(tuple(_plain(row[i]) for i in order) for row in cursor.fetchall())
    return [names[i] for i in order], rows


def difference(df, con, sql: str) -> str | None:
    """None if both sides hold the same rows, else what differs."""
    names, got = spark_rows(df)
    expected_names, expected = oracle_rows(con, sql)
    if names != expected_names:
        return f"columns {names} against {expected_names}"
    if got != expected:
        extra, missing = got - expected, expected - got
        return (
            f"{sum(got.values())} rows against {sum(expected.values())}; "
            f"only Spark {list(extra)[:2]}; only SQL {list(missing)[:2]}"
        )
    return None


def main(sf_dir: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry_points

    from tallyglass.session import build_session

    spark = build_session("compare", "local[8]", 8, {"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    oracles = entry_points.oracle_sql()
    failed = 0
    for name, build in entry_points.queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        try:
            df = build(spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                rows = "same" if problem is None else problem
            else:
                problem, rows = None, f"{df.count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            problem = rows = f"{type(error).__name__}: {str(error)[:1200]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - began:.2f}s {rows}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
