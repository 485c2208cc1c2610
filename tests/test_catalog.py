import glob
import math

import duckdb
import pytest

from millrace.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(x):
    return round(x, 5) + 0.0 if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, con, name):
    want = con.sql(catalog.ORACLE_SQL[name]).to_arrow_table()
    got = catalog.QUERIES[name](spark, SF).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    names = sorted(got.column_names)
    kind = lambda t: [str(t.schema.field(n).type).replace("large_", "").replace("_view", "") for n in names]
    assert kind(got) == kind(want)
    rows = lambda t: sorted(repr(tuple(map(plain, r))) for r in zip(*(t.column(n).to_pylist() for n in names)))
    assert rows(got) == rows(want)


def test_entry_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())
