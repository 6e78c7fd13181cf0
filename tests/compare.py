"""Run a query in Spark and its SQL in DuckDB and compare columns and rows."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x) if x % 1 else int(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else (0.0 if x == 0 else x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in at], sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)


def duck(sql: str, folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    found = connection.execute(sql)
    return ordered([d[0] for d in found.description], found.fetchall())


def spark_rows(frame):
    return ordered(frame.columns, [tuple(r) for r in frame.collect()])


def difference(frame, sql: str, folder: str) -> str:
    """Empty if both agree, else what differs."""
    columns, rows = spark_rows(frame)
    want_columns, want = duck(sql, folder)
    if columns != want_columns:
        return f"columns {columns} and {want_columns}"
    if rows != want:
        odd = [(a, b) for a, b in zip(rows, want, strict=False) if a != b]
        return f"rows {len(rows)} and {len(want)}; {odd[:3]}"
    return ""
