"""Every registered query of stored graphs, refusals, plans and streams against its SQL."""

import os
from decimal import Decimal

import duckdb
import pytest

from voltweave import catalog, catalog_storage


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in ("lineitem", "orders", "part", "customer", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir("/root/testdata"), reason="needs the test tables")
@pytest.mark.parametrize("name", list(catalog_storage.QUERIES))
def test_query_equals_sql(spark, small, duck, name):
    got = catalog_storage.QUERIES[name](spark, small)
    wanted = duck.execute(catalog_storage.ORACLES[name])
    columns = [d[0] for d in wanted.description]
    assert sorted(columns) == sorted(got.columns)
    plain = lambda row: tuple((v is None, int(v) if isinstance(v, Decimal) else 0 if v is None else v) for v in row)
    rows = sorted(map(plain, wanted.fetchall()))
    assert rows and sorted(map(plain, got.select(*columns).collect())) == rows


def test_names_are_distinct():
    assert not set(catalog.QUERIES) & set(catalog_storage.QUERIES)
