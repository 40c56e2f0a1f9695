"""The queries that SQL can express against their SQL, where the driver's small tables are there."""

import os

import duckdb
import pytest

from edgeloom.llm import queries

TABLES = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TABLES}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, sql, name):
    got = queries.queries()[name](spark, TABLES)
    found = sql.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    columns = sorted(got.columns)
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == want


def test_checksums_in_sql(sql):
    import zlib

    texts = ["", "a", "Ä ß 語", "x" * 5000, "123456789"]
    for text in texts:
        got = sql.execute(f"WITH {queries._CRC_TABLE} SELECT {queries._crc('v')} FROM t, (SELECT CAST(? AS varchar) AS v) q", [text]).fetchone()[0]
        assert got == zlib.crc32(text.encode())
