"""Holds a query's rows against its DuckDB oracle."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(names: list[str], found) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


def difference(df, sql: str, con) -> str:
    """Empty if the same columns and rows come from both."""
    names = df.columns
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    theirs = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(theirs):
        return f"columns {sorted(names)} and {sorted(theirs)}"
    a, b = rows(names, got), rows(theirs, want)
    if a == b:
        return ""
    x, y = set(a), set(b)
    return f"{len(a)} and {len(b)} rows; only here {sorted(x - y)[:2]}, only there {sorted(y - x)[:2]}"
