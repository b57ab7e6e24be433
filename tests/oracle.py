"""Runs a query and its SQL over the same tables and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(value(r[i]) for i in order) for r in found)


def same(spark, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    want = connection(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    got, other = rows(df.columns, df.collect()), rows(want.columns, want.fetchall())
    assert got == other
    return got
