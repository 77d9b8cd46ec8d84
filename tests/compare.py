"""Run a registered query in Spark and its SQL in DuckDB; compare rows as unordered multisets of exact values."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, bool):
        return str(v)
    return f"{type(v).__name__}:{v}"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def diff(df, sql: str, con) -> tuple[int, str | None]:
    got = df.collect()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(set(names) ^ set(df.columns))}"
    a, b = _rows(df.columns, [tuple(r) for r in got]), _rows(names, want)
    if len(a) != len(b):
        return len(got), f"rows {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            cols = sorted(names)
            return len(got), f"{[(c, p, q) for c, p, q in zip(cols, x, y) if p != q][:6]} of {x[:4]}"
    return len(got), None
