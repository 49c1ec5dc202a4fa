"""Spark rows against DuckDB rows: columns by name, rows in any order, values equal."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 4) + 0.0
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if hasattr(x, "as_tuple"):
        return round(float(x), 4) + 0.0
    return float(x) if isinstance(x, int) else x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(df, con, sql: str) -> str:
    """Empty where Spark and DuckDB agree; else the first thing that differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows(names, cursor.fetchall())
    got = rows(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}: {[r for r in got if r not in want[:5000]][:1]} / {want[:1]}"
    off = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(off)} rows differ: {off[0]}" if off else ""
