"""Compares a query with its SQL on the small tables."""

import decimal
import math

import duckdb

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else round(float(v), 6)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(spark, query, sql, folder=DIR):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
    assert got == want
    return len(got)
