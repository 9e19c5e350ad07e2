"""Runs queries on Spark and their SQL twins on DuckDB and compares the rows.

    python tests/oracle_check.py [scale folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(row[i]) for i in order)) for row in rows)


def compare(spark, connection, sf_dir: str, name: str) -> str | None:
    """None when both sides agree, else what differs."""
    frame = entry.queries()[name](spark, sf_dir)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = connection.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(columns)}"
    if not ours:
        return "no rows"
    if ours == theirs:
        return None
    left = sorted(set(ours) - set(theirs))[:2]
    right = sorted(set(theirs) - set(ours))[:2]
    return f"{len(ours)} rows against {len(theirs)}; only ours {left}; only theirs {right}"


if __name__ == "__main__":
    from tidemark.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or sorted(entry.queries())
    session = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8"})
    session.sparkContext.setLogLevel("OFF")
    connection = duck(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in entry.oracle_sql():
                answer = compare(session, connection, folder, name)
            else:
                answer = None if entry.queries()[name](session, folder).count() > 0 else "no rows"
        except Exception as error:  # report every query
            answer = f"{type(error).__name__}: {str(error)[:600]}"
        bad += answer is not None
        print(f"@@ {'ok ' if answer is None else 'BAD'} {name} {time.time() - start:.1f}s {answer or ''}"[:1500], flush=True)
    print(f"@@ {len(names) - bad} of {len(names)} fine")
