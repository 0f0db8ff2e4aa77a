"""Run a Spark query and its DuckDB oracle on the same parquet tables and compare.

Mirrors the driver's check: columns sorted by name, row count, and an
order-insensitive hash of the values.  Also reports near-equality so a
mismatch can be told from float noise.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [tuple(_norm(r[i]) for i in order) for r in rows], sorted(names)


def value_hash(rows) -> str:
    h = [hashlib.md5(repr(r).encode()).hexdigest() for r in rows]
    return hashlib.md5("".join(sorted(h)).encode()).hexdigest()


def _key(r):
    return tuple((0, "") if x is None else (1, str(type(x).__name__), x) for x in r)


def close(a, b, tol=1e-9):
    if len(a) != len(b):
        return False
    for x, y in zip(sorted(a, key=_key), sorted(b, key=_key)):
        for u, v in zip(x, y):
            if isinstance(u, float) or isinstance(v, float):
                if u is None or v is None:
                    if u is not v:
                        return False
                elif not math.isclose(u, v, rel_tol=tol, abs_tol=tol):
                    return False
            elif u != v:
                return False
    return True


def compare(spark, con, name, fn, sql, sf_dir, sdf=None):
    sdf = fn(spark, sf_dir) if sdf is None else sdf
    s_rows, s_names = _rows(sdf.columns, [tuple(r) for r in sdf.collect()])
    cur = con.execute(sql)
    d_names = [c[0] for c in cur.description]
    d_rows, d_names = _rows(d_names, cur.fetchall())
    return {
        "name": name,
        "rows": (len(s_rows), len(d_rows)),
        "schema": s_names == d_names,
        "names": (s_names, d_names) if s_names != d_names else None,
        "hash": value_hash(s_rows) == value_hash(d_rows),
        "close": close(s_rows, d_rows),
        "s_rows": s_rows, "d_rows": d_rows,
    }
