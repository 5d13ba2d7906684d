"""Every registered query of the schedule engine against its SQL in DuckDB."""

import duckdb
import pytest

from calspar.plans import arrivals, live, registry

QUERIES, ORACLES = registry.queries() | arrivals.queries() | live.queries(), registry.oracle_sql() | arrivals.oracle_sql() | live.oracle_sql()

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toArrow()
    want = duck.execute(ORACLES[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)

    def rows(table):
        return sorted(map(repr, zip(*[table.column(c).to_pylist() for c in names])))

    assert rows(got) == rows(want)
    assert rows(got)
