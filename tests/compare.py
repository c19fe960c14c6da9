"""Rows of a Spark query against rows of its SQL."""

import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name.split('.')[0]} as select * from '{folder}/{name}'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, float):
        return None if v != v else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    try:
        return plain(v.item()) if hasattr(v, "item") else (int(v) if float(v) == int(v) else float(v))
    except (TypeError, ValueError):
        return str(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())


def sql_rows(con, text):
    rel = con.sql(text)
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return cols, sorted(repr([plain(r[k]) for k in at]) for r in rel.fetchall())
