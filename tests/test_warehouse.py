"""Bucketed storage removes the order_id shuffles and keeps results equal."""

import os
import tempfile

import pytest

from repeatlens.plans import hypothesis, kpis
from repeatlens.scope import driver_scope
from repeatlens.sources.driver_adapter import from_driver_tables
from repeatlens.sources.warehouse import read_colocated, write_colocated

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_colocated_tables_avoid_order_shuffle(spark):
    mp = from_driver_tables(spark, SF)
    loc = tempfile.mkdtemp(prefix="repeatlens-wh-")
    write_colocated(spark, mp, "rl_test_wh", loc, buckets=8)
    wh = read_colocated(spark, "rl_test_wh")
    s = driver_scope()
    plan = kpis.exec_kpis(wh, s)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(order_id" not in plan
    assert kpis.exec_kpis(wh, s).collect() == kpis.exec_kpis(mp, s).collect()
    a = sorted(hypothesis.payment(wh, s).collect())
    b = sorted(hypothesis.payment(mp, s).collect())
    assert a == b


def test_month_partitioned_orders_prune_and_match(spark):
    from repeatlens.sources.csv_source import read_marketplace_parquet, write_canonical

    mp = from_driver_tables(spark, SF)
    out = tempfile.mkdtemp(prefix="repeatlens-canon-")
    write_canonical(mp, out, by_month=True)
    pmp = read_marketplace_parquet(spark, out)
    s = driver_scope()
    plan = kpis.exec_kpis(pmp, s)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(purchase_month" in plan
    assert kpis.exec_kpis(pmp, s).collect() == kpis.exec_kpis(mp, s).collect()
    assert sorted(hypothesis.geography(pmp, s).collect()) == sorted(hypothesis.geography(mp, s).collect())
