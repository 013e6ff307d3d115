"""Runs registered queries against DuckDB: python -m checks.compare [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from catalog_engine.session import local_session
from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def _bag(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def difference(spark, connection, sf_dir: str, name: str) -> str | None:
    """None where Spark and DuckDB give the same columns and the same bag of rows."""
    frame = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    if name not in ORACLE:
        return None if got else "no rows"
    cursor = connection.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(columns)}"
    ours, theirs = _bag(frame.columns, got), _bag(columns, want)
    if ours == theirs:
        return None
    extra, lacking = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return f"{len(got)} rows against {len(want)}; only Spark {extra}; only SQL {lacking}"


def main(arguments: list[str]) -> int:
    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(QUERIES)
    spark, connection = local_session(8), connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = difference(spark, connection, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
