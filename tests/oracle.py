"""Runs a query and its SQL counterpart and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str(v)


def compare(query, sql: str, spark, folder: str) -> None:
    df = query(spark, folder)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(folder):
        db.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    rel = db.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
