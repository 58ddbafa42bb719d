"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import duckdb
import pytest

import __spark_entry__ as entry
from edgeloom.plans import registry
from tools.oracle_check import TABLES, rows

SF = "/root/testdata/sf0.001"
# the library's own queries; the optional corpus operators have tests of their own
QUERIES = {k: f for k, f in entry.queries().items() if k in registry.REGISTRY}
ORACLES = {k: q for k, q in entry.oracle_sql().items() if k in registry.REGISTRY}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sp = QUERIES[name](spark, SF).toPandas()
    dk = con.sql(ORACLES[name]).df()
    cs, rs = rows(sp)
    cd, rd = rows(dk)
    assert cs == cd
    assert len(sp) == len(dk)
    assert rs == rd


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "total_connections"]
    assert df.count() == 1
