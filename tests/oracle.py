"""Spark rows against DuckDB rows over the same tables."""

from __future__ import annotations

import glob
import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb


def connection(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(x):
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        return float(f"{x:.9g}") + 0.0
    if isinstance(x, Decimal):
        return plain(float(x)) if x % 1 else int(x)
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return [plain(y) for _, y in sorted(x.items(), key=lambda kv: str(kv[0]))]
    if hasattr(x, "item"):
        return plain(x.item())
    return x


def rows(names: list[str], data: list) -> tuple[list[str], list[str]]:
    by = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in by], sorted(repr([plain(r[i]) for i in by]) for r in data)


def difference(spark, root: str, con, query, sql: str) -> str:
    """Empty where both give the same rows under the same names."""
    df = query(spark, root)
    own_names, own = rows(df.columns, [list(r) for r in df.collect()])
    got = con.execute(sql)
    their_names, theirs = rows([d[0] for d in got.description], got.fetchall())
    if own_names != their_names:
        return f"columns {own_names} against {their_names}"
    if len(own) != len(theirs):
        return f"{len(own)} rows against {len(theirs)}"
    for a, b in zip(own, theirs, strict=True):
        if a != b:
            return f"{sum(x != y for x, y in zip(own, theirs, strict=True))} of {len(own)} rows differ:\n{a}\n{b}"
    return ""
