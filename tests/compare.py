"""Compares a query's rows with those of its SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return round(float(x), 6) + 0.0
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def sql_rows(folder: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    out = con.execute(sql)
    return [d[0] for d in out.description], out.fetchall()


def difference(spark, folder: str, query, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, folder)
    names, rows = sql_rows(folder, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, rows)
    if a == b:
        return ""
    only = [x for x in a if x not in b][:2], [x for x in b if x not in a][:2]
    return f"{len(a)} and {len(b)} rows; only in one: {only}"
