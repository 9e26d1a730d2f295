"""Every oracle-checked query: Spark result == DuckDB SQL on the driver tables."""

import os

import pytest

from repeatlens.catalog import queries
from repeatlens.oracle import build
from repeatlens.parity import compare, duckdb_connection, same_representation

SF = os.environ.get("REPEATLENS_PARITY_SF", "/root/testdata/sf0.01")
SQL = build()
NAMES = [k for k in queries() if k in SQL]


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = queries()[name](spark, SF).toPandas()
    exp = con.execute(SQL[name]).df()
    ok, msg = compare(got, exp)
    assert ok, f"{name}: {msg}"
    ok, msg = same_representation(got, exp)
    assert ok, f"{name}: {msg}"


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
