"""Compares a query with its SQL twin in DuckDB, as sorted rows."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(folder=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folder}/{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def check(df, sql, con):
    columns = sorted(df.columns)
    got = Counter(repr(tuple(plain(v) for v in r)) for r in df.select(columns).collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(repr(tuple(plain(r[i]) for i in at)) for r in res.fetchall())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])
