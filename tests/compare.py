"""Row-by-row comparison of a registered query with its SQL twin in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canon(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return None if math.isnan(number) else round(number, 6) + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canon(row[i]) for i in order) for row in rows)


def compare(spark, con, folder: str, fn, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    df = fn(spark, folder)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return None if want else "both empty"
    return (
        f"rows {sum(got.values())} vs {sum(want.values())}; cols {sorted(names)}; "
        f"spark only {list((got - want).items())[:4]}; sql only {list((want - got).items())[:4]}"
    )
