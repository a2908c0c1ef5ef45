"""Comparison of a Spark result with DuckDB's answer on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(found, columns):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(normal(x) for x in r) for r in found), key=key)


def assert_same(df, sql, sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    columns = sorted(df.columns)
    want = con.execute("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({sql}) q").fetchall()
    got = df.select(*[f"`{c}`" for c in columns]).collect()
    assert rows(got, columns) == rows(want, columns)
