"""Run registered queries next to their oracles and compare rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def oracle_rows(sf_dir: str, sql: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    result = connection.execute(sql)
    return [d[0] for d in result.description], result.fetchall()


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.6f}"
    return "null" if value is None else str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, sf_dir, query, sql):
    """None if equal, else a short account of what differs."""
    frame = query(spark, sf_dir)
    names, rows = normal(frame.columns, [tuple(r) for r in frame.collect()])
    expected_names, expected = normal(*oracle_rows(sf_dir, sql))
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if rows != expected:
        extra = sorted(set(rows) - set(expected))[:3]
        missing = sorted(set(expected) - set(rows))[:3]
        return f"{len(rows)} rows, {len(expected)} expected; extra {extra}, missing {missing}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1]
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        started = time.time()
        sql = entry.oracle_sql().get(name)
        try:
            if sql is None:
                said = f"{query(session, sf).count()} rows, no oracle"
            else:
                said = differences(session, sf, query, sql) or "equal"
        except Exception as error:  # report and go on
            said = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:24s} {time.time() - started:6.1f}s {said[:900]}", flush=True)
