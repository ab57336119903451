"""Compares a query's rows with DuckDB's on the same tables, in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(str, frame.itertuples(index=False, name=None)))


def assert_same(spark, query, sql, directory):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{directory}/{t}.parquet"
        con.sql(f"create view {t} as from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    got, want = query(spark, directory).toPandas(), con.sql(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
    return got
