"""Side-by-side comparison of a Spark result with its DuckDB twin."""

from __future__ import annotations

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, Decimal):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both have the same columns and the same rows, repeats included."""
    names, ours = bag(df.columns, df.collect())
    cur = con.execute(sql)
    twin_names, twin = bag([d[0] for d in cur.description], cur.fetchall())
    if names != twin_names:
        return f"columns {names} against {twin_names}"
    if ours == twin:
        return ""
    return f"{sum(ours.values())} rows against {sum(twin.values())}; only here {list((ours - twin).items())[:2]}; only there {list((twin - ours).items())[:2]}"
