"""Run a named query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str, int)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(value))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if type(value).__name__ == "Decimal":
        return float(value)
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in data)


def difference(spark, con, fn, sql, folder) -> str:
    """Empty when both sides agree, else a short account."""
    df = fn(spark, folder)
    names, got = rows(df.columns, df.collect())
    res = con.execute(sql)
    want_names, want = rows([c[0] for c in res.description], res.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if got == want:
        return "" if sum(got.values()) else "both empty"
    only_spark, only_sql = list((got - want).items())[:3], list((want - got).items())[:3]
    return f"rows {sum(got.values())} vs {sum(want.values())}\n  spark only {only_spark}\n  sql only   {only_sql}"
