"""Runs a query and its SQL twin over one data folder and compares their rows."""

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return bytes(value).hex() if isinstance(value, (bytes, bytearray)) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, query, sql):
    df = query(spark, DATA)
    ours = rows_of(df.columns, df.collect())
    if sql is None:
        return ours
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    cursor = con.execute(sql)
    assert ours == rows_of([c[0] for c in cursor.description], cursor.fetchall())
    return ours
