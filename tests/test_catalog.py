"""Every registered graph query against its DuckDB text."""

from __future__ import annotations

import duckdb
import pytest

from weftgraph import catalog, catalog_links  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = ("supplier", "customer", "part", "orders", "lineitem", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(r) for r in got.select(*(f"`{c}`" for c in columns)).collect()]
    wanted = want.fetchall()
    assert sorted(rows, key=repr) == sorted(wanted, key=repr)
