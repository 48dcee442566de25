"""Run a query in Spark and its SQL in DuckDB, and compare the whole results."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if value != value else value
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _kind(value) -> str:
    return "float" if isinstance(value, decimal.Decimal) else type(value).__name__


def table(columns: list[str], rows: list) -> tuple[list[str], list, dict]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    kinds = {
        names[j]: {_kind(r[i]) for r in rows if r[i] is not None} for j, i in enumerate(order)
    }
    return names, sorted(plain, key=repr), kinds


def difference(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a description of the first difference."""
    ours = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    theirs = table([c[0] for c in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])}"
    if ours[2] != theirs[2]:
        return f"types {ours[2]} != {theirs[2]}"
    for a, b in zip(ours[1], theirs[1]):
        if a != b:
            different = sum(x != y for x, y in zip(ours[1], theirs[1]))
            return f"{different} rows differ, first {str(a)[:300]} != {str(b)[:300]}"
    return None
