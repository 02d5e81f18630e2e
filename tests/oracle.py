"""Compare a registered query with its SQL check in DuckDB, row by row."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return float(v) + 0.0
    return str(v)


def _key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=_key)


def differences(spark, con, fn, sql, sf_dir, show=3) -> list[str]:
    df = fn(spark, sf_dir)
    got_columns = df.columns
    got = _rows(got_columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_columns = [c[0] for c in res.description]
    want = _rows(want_columns, res.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return [f"columns {sorted(got_columns)} != {sorted(want_columns)}"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)} rows", *[f"  got {g} want {w}" for g, w in zip(got[:show], want[:show])]]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return [f"{len(bad)} of {len(got)} rows differ", *[f"  got {g}\n  want {w}" for g, w in bad[:show]]] if bad else []
