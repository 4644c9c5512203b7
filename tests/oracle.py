"""Runs a registered query and its SQL in DuckDB on the same tables and compares the rows."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def compare(spark, query, sql: str, sf_dir: str) -> int:
    """Asserts equal columns and rows; returns the number of rows."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = connect(sf_dir).execute(sql)
    columns = [d[0] for d in res.description]
    want = rows(columns, res.fetchall())
    assert sorted(df.columns) == sorted(columns), (sorted(df.columns), sorted(columns))
    assert len(got) == len(want), (len(got), len(want), [x for x in got if x not in want][:3], [x for x in want if x not in got][:3])
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    assert not wrong, wrong[:3]
    return len(got)
