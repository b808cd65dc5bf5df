"""Compare a registered query with its SQL, value by value."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def differences(df, db, sql: str) -> str | None:
    """None if both sides agree in columns, types and all rows."""
    cursor = db.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    for name, kind in df.dtypes:
        if KINDS.get(kind) != kinds[name]:
            return f"type of {name}: {kind} and {kinds[name]}"
    expected = _rows(names, cursor.fetchall())
    actual = _rows(df.columns, df.collect())
    if len(expected) != len(actual):
        return f"{len(actual)} rows, not {len(expected)}"
    wrong = [(a, e) for a, e in zip(actual, expected, strict=True) if a != e]
    return f"{len(wrong)} of {len(actual)} rows, as {str(wrong[0])[:1500]}" if wrong else None
