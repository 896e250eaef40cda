"""Rows of a Spark query and of its SQL in DuckDB, brought to one form."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def same(df, db, sql: str) -> str:
    """Empty if both give the same rows; else what differs."""
    out = db.sql(sql)
    a, b = rows_of(df.columns, df.collect()), rows_of(out.columns, out.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if not a[1] and not b[1]:
        return "no rows on either side"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    return next((f"{x} and {y}" for x, y in zip(a[1], b[1]) if x != y), "")
