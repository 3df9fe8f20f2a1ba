"""Every registered graph query against its SQL."""

import os
from decimal import Decimal

import duckdb
import pytest

from voltweave import catalog


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in ("lineitem", "orders", "part", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir("/root/testdata"), reason="needs the test tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, small, duck, name):
    got = catalog.QUERIES[name](spark, small)
    wanted = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(got.columns)
    plain = lambda row: tuple(int(v) if isinstance(v, Decimal) else v for v in row)
    assert sorted(map(plain, got.select(*columns).collect())) == sorted(map(plain, wanted.fetchall()))
