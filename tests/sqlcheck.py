"""Holds a query's rows against DuckDB's."""

import glob
import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def same(spark, con, query, sql, folder):
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    r = con.execute(sql)
    assert got == rows([c[0] for c in r.description], r.fetchall())
