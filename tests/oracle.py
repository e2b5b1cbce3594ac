"""Compares registered queries with their SQL equivalents; also a command-line check."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else float(value)
    return value


def kind(value):
    return "null" if value is None else type(value).__name__


def difference(spark_df, connection, sql):
    """None when both sides agree in columns, types of values, rows and values."""
    names = sorted(spark_df.columns)
    left = [tuple(plain(row[n]) for n in names) for row in spark_df.collect()]
    result = connection.execute(sql)
    found = [c[0] for c in result.description]
    if sorted(found) != names:
        return f"columns {names} vs {sorted(found)}"
    places = [found.index(n) for n in names]
    right = [tuple(plain(row[p]) for p in places) for row in result.fetchall()]
    if len(left) != len(right):
        return f"{len(left)} rows vs {len(right)}"
    key = lambda row: tuple((v is None, str(v)) for v in row)
    left, right = sorted(left, key=key), sorted(right, key=key)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, first: {str(wrong[0])[:700]}"
    odd = {(kind(x), kind(y)) for a, b in zip(left, right) for x, y in zip(a, b) if kind(x) != kind(y)}
    return f"value types {odd}" if odd else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder, chosen = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql = connect(folder), entry.oracle_sql()
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            result = difference(df, connection, sql[name]) if name in sql else f"no SQL, {df.count()} rows"
        except Exception as error:  # report and go on
            result = f"ERROR {type(error).__name__} {str(error)[:600]}"
        print(f"{name:24s} {time.time() - start:6.1f}s  {result or 'ok'}", flush=True)
