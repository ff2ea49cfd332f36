"""Queries against DuckDB on the same files, rows in any order."""

import os

import duckdb


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(f"{float(v):.9g}") if type(v).__name__ == "Decimal" else v


def both(spark, run, sql, sf):
    """Sorted rows of Spark and of DuckDB, columns by name."""
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    df, rel = run(spark, sf), con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    mine = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    return mine, sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
