"""Compare registered queries with their reference SQL on a data folder.

Usage: python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(" ")
    return value


def sorted_rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return df.columns, [tuple(r) for r in df.collect()]


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


SPENT = {}


def difference(spark, con, function, sql: str | None, folder: str) -> tuple[str, int]:
    """('' when equal, else what differs; number of rows)."""
    start = time.time()
    names, rows = spark_rows(function(spark, folder))
    SPENT["spark"] = time.time() - start
    if sql is None:
        return "", len(rows)
    sql_names, expected = sql_rows(con, sql)
    if sorted(names) != sorted(sql_names):
        return f"columns {sorted(names)} != {sorted(sql_names)}", len(rows)
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}", len(rows)
    ours, theirs = sorted_rows(names, rows), sorted_rows(sql_names, expected)
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} rows differ, first {wrong[0]}", len(rows)
    return "", len(rows)


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from vigilog.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, sqls = local_session(8), connect(folder), oracle_sql()
    bad = 0
    for name, function in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem, n = difference(spark, con, function, sqls.get(name), folder)
        except Exception as error:
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += bool(problem)
        kind = "rows-only" if name not in sqls else "ok" if not problem else "DIFF"
        print(f"{kind:9} {name:28} {n:8} {time.time() - start:6.2f}s (spark {SPENT.get('spark', 0):5.2f}s) {problem[:900]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
