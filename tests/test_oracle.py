"""The catalog's queries against their SQL, where the driver's small tables are there."""

import os

import duckdb
import pytest

from edgeloom.plans import catalog

TABLES = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TABLES}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows(spark, sql, name):
    got = catalog.queries()[name](spark, TABLES)
    found = sql.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in found.description]
    columns = sorted(got.columns)
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == want
