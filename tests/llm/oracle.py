"""Compares a query with its SQL on the same tables."""

import glob

import duckdb


def same(spark, query, sql, sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(sql).to_arrow_table()
    got = query(spark, sf).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    names = sorted(got.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t.column(n).to_pylist() for n in names))))
    assert rows(got) == rows(want)
    return got
