"""Compare registered queries with their SQL on one table directory.

    python tests/oracle_check.py [directory] [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.date().isoformat() if value.time() == datetime.time() else value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, float):
        if not math.isfinite(value):
            return str(value)
        return int(value) if value == int(value) else value
    return value


def as_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), as_rows(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(connection, query: str) -> tuple[list[str], list[tuple]]:
    result = connection.execute(query)
    columns = [d[0] for d in result.description]
    return sorted(columns), as_rows(columns, result.fetchall())


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tidecast.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = connect(sf_dir), 0
    for name in wanted:
        started = time.time()
        try:
            got = spark_rows(queries()[name](spark, sf_dir))
            spent = time.time() - started
            if name not in oracle_sql():
                print(f"rows  {name:28s} {len(got[1]):6d} rows {spent:6.2f}s {got[0]}")
                continue
            started = time.time()
            expected = sql_rows(connection, oracle_sql()[name])
            sql_spent = time.time() - started
        except Exception as error:  # report every query, then fail
            failed += 1
            print(f"ERROR {name:28s} {str(error)[:600]}")
            continue
        same = got == expected
        failed += not same
        mark = "ok   " if same else "DIFF "
        print(f"{mark} {name:28s} {len(got[1]):6d} rows {spent:6.2f}s sql {sql_spent:5.2f}s")
        if not same:
            print("   columns", got[0], expected[0], len(got[1]), len(expected[1]))
            for a, e in [(a, e) for a, e in zip(got[1], expected[1]) if a != e][:3]:
                print("   spark", a, "\n   sql  ", e)
    print("failed", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
