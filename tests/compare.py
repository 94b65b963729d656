"""Run registered queries on Spark and their DuckDB twins; compare rows, columns and values."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def canon(cols: list[str], rows: list[tuple]) -> tuple[list[str], str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return [cols[i] for i in order], hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, name: str, fn, sql: str, sf_dir: str, con=None) -> dict:
    con = con or duck(sf_dir)
    df = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    s_cols, s_hash = canon(df.columns, s_rows)
    res = con.execute(sql)
    d_cols_raw = [c[0] for c in res.description]
    d_rows = res.fetchall()
    d_cols, d_hash = canon(d_cols_raw, d_rows)
    return {
        "name": name,
        "spark_rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "cols_match": s_cols == d_cols,
        "hash_match": s_hash == d_hash,
        "spark_cols": s_cols,
        "oracle_cols": d_cols,
    }
