"""Compares a query with its SQL on the same tables, whatever the order of rows."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return round(float(x), 5) + 0.0
    if isinstance(x, datetime.datetime) and x.tzinfo is None and x == datetime.datetime(x.year, x.month, x.day):
        return str(x.date())
    return str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


def compare(spark, f, sql: str, sf_dir: str) -> int:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    theirs = c.sql(sql)
    ours = f(spark, sf_dir)
    assert sorted(theirs.columns) == sorted(ours.columns)
    a, b = rows(theirs.columns, theirs.fetchall()), rows(ours.columns, [tuple(r) for r in ours.collect()])
    assert len(a) == len(b)
    assert a == b
    return len(a)
