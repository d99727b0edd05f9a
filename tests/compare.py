"""Run a registered query next to its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

from vetline.feeds import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "\0null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """Empty text when equal, else what differs."""
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rows_of(names, rel.fetchall())
    types = {d[0]: str(d[1]) for d in rel.description}
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(mine)
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    bad = [(c, t, types[c]) for c, t in df.dtypes if kinds.get(t, t) != types[c]]
    if mine != theirs:
        extra, lack = sorted(set(mine) - set(theirs))[:3], sorted(set(theirs) - set(mine))[:3]
        return f"rows {len(mine)} vs {len(theirs)} cols {sorted(names)}\n  spark {extra}\n  sql   {lack}", len(mine)
    if bad:
        return f"types {bad}", len(mine)
    return "", len(mine)
