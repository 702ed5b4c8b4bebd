"""Comparison of a DataFrame with DuckDB's rows for the same SQL."""

import os

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def same_rows(df, sql, folder, tables=TABLES):
    con = duckdb.connect()
    for t in tables:
        files = f"{folder}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{folder}/{t}.parquet") else "")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{files}'")
    rel = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    order = [rel.columns.index(n) for n in names]
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in rel.fetchall())
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*names).collect())
    assert got == want
