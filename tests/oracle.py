"""Holds a query against its SQL in DuckDB on the same tables."""

import math
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def _key(row):
    return tuple((v is None, type(v).__name__, v if v is not None else 0) for v in row)


def same(spark, data, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    df = query(spark, data)
    names = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=_key)
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    want = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=_key)
    assert got == want
