"""Runs a query and its SQL on the same tables and compares the rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        v = round(v, 5) + 0.0
        return str(int(v)) if v.is_integer() else repr(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same_rows(spark, f, sql, root=ROOT):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    got, want = f(spark, root), con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got.columns, got.collect()), rows_of(want.columns, want.fetchall())
    assert len(a) == len(b)
    assert a == b
