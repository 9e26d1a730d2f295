"""Spark SQL scripts give exactly the DataFrame jobs' results."""

import os

import pytest

from repeatlens.catalog import JOBS
from repeatlens.parity import compare
from repeatlens.plans.sql_scripts import run_sql, scripts
from repeatlens.scope import driver_scope
from repeatlens.sources.driver_adapter import from_driver_tables

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.mark.parametrize("name", sorted(scripts(driver_scope())))
def test_sql_script_equals_job(spark, name):
    mp = from_driver_tables(spark, SF)
    s = driver_scope()
    got = run_sql(spark, mp, s, name).toPandas()
    exp = JOBS[name](mp, s).toPandas()
    assert list(got.columns) == list(exp.columns)
    ok, msg = compare(got, exp)
    assert ok, msg
