"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import collections
import decimal
import math
import os


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def rows(df):
    cols = sorted(df.columns)
    return collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path}'")
    return con


def check(spark, folder, con, query, sql):
    df = query(spark, folder)
    rel = con.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(df.columns)]
    want = collections.Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    got = rows(df)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
