"""Compares a query with its SQL on DuckDB."""

import glob
import math
import os

import duckdb


def normal(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return str(v) if not isinstance(v, (int, bool)) else repr(v)


def connect(data):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def same(spark, data, con, query, sql):
    df = query(spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(normal(r[k]) for k in at) for r in cur.fetchall()), key=repr)
    assert got == want
