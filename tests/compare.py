"""Runs queries and their SQL counterparts side by side: ``python tests/compare.py [sf] [key ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return repr(value)
    return str(value)


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, connection, folder: str, key: str, query, sql: str | None) -> str | None:
    """None if the two agree, else what differs."""
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None
    cursor = connection.execute(sql)
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = [r for r in got[1] if r not in set(want[1])][:2]
        missing = [r for r in want[1] if r not in set(got[1])][:2]
        return f"{len(got[1])} rows against {len(want[1])}; only here {extra}; only there {missing}"
    wrong = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(wrong)} rows differ, e.g. {wrong[0]}"[:1500] if wrong else None


def main() -> None:
    import __spark_entry__ as entry
    from filelake.session import build_session

    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql = duck(folder), entry.oracle_sql()
    for key, query in entry.queries().items():
        if len(sys.argv) > 2 and key not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            fault = compare(spark, connection, folder, key, query, sql.get(key))
        except Exception as e:
            fault = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok  ' if fault is None else 'FAIL'} {key:24s} {time.time() - start:6.2f}s {fault or ''}", flush=True)


if __name__ == "__main__":
    main()
