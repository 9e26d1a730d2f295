"""Months reloaded alone, partial marts re-added, sketches within their error."""

import os

import pytest
from pyspark.sql import functions as F

from repeatlens.catalog import registered_scope
from repeatlens.parity import compare
from repeatlens.plans import kpis, partials, rfm
from repeatlens.sources.csv_source import read_marketplace_parquet, write_canonical
from repeatlens.sources.driver_adapter import from_driver_tables
from repeatlens.sources.incremental import reload_months
from tests.builders import SCOPE, market, order

SF = "/root/testdata/sf0.001"


def files(folder):
    """{directory: its files} of all Parquet files below a folder."""
    out = {}
    for at, _, names in os.walk(folder):
        held = {n for n in names if n.endswith(".parquet")}
        if held:
            out[os.path.relpath(at, folder)] = held
    return out


def small(spark, more=(), late_price=10, march=True):
    orders = [order("o1", "c1", "2017-01-05 10:00:00"), order("o2", "c2", "2017-02-05 10:00:00"), *more]
    items = [("o1", 1, "p1", "s", 10, 1), ("o2", 1, "p1", "s", 20, 2), ("o2", 2, "p2", "s", 5, 2)]
    if march:
        orders.append(order("o3", "c3", "2017-03-09 10:00:00"))
        items.append(("o3", 1, "p2", "s", late_price, 1))
    cust = [("c1", "u1", "SP"), ("c2", "u2", "SP"), ("c3", "u1", "RJ"), ("c4", "u4", "RJ")]
    return market(spark, orders, items, cust, [("p1", "cat"), ("p2", "dog")],
                  [("cat", "cat_en"), ("dog", "dog_en")], [("o1", "card", 2, 10), ("o3", "card", 1, 7)],
                  [("o1", 4)])


def test_a_reload_touches_its_months_only(spark, tmp_path):
    folder, marts = str(tmp_path / "tables"), str(tmp_path / "marts")
    write_canonical(small(spark), folder)
    partials.write_partials(read_marketplace_parquet(spark, folder), SCOPE, marts)
    before, marts_before = files(folder), files(marts)
    new = small(spark, [order("o4", "c4", "2017-03-20 10:00:00")], late_price=99)
    new = new.__class__(**{**new.__dict__, "order_items": new.order_items.union(
        new.order_items.filter("order_id = 'o3'").withColumn("order_id", F.lit("o4")))})
    reload_months(new, folder, ["2017-03"])
    mp = read_marketplace_parquet(spark, folder)
    partials.write_partials(mp, SCOPE, marts, ["2017-03"])
    for old, now in ((before, files(folder)), (marts_before, files(marts))):
        for at, names in old.items():
            if "purchase_month" in at:
                assert (now[at] == names) == ("2017-03" not in at), at
    parts = partials.read_partials(spark, marts)
    pairs = [(partials.exec_kpis(parts), kpis.exec_kpis(new, SCOPE)),
             (partials.monthly_revenue_trend(parts), kpis.monthly_revenue_trend(new, SCOPE)),
             (partials.regional_performance(parts), kpis.regional_performance(new, SCOPE)),
             (partials.category_performance(parts, SCOPE), kpis.category_performance(new, SCOPE)),
             (partials.rfm_base(parts, SCOPE), rfm.rfm_base(new, SCOPE))]
    for got, want in pairs:
        assert compare(got.toPandas(), want.toPandas()) == (True, "ok")


def test_a_month_without_rows_goes(spark, tmp_path):
    folder, marts = str(tmp_path / "tables"), str(tmp_path / "marts")
    write_canonical(small(spark), folder)
    partials.write_partials(small(spark), SCOPE, marts)
    reload_months(small(spark, march=False), folder, ["2017-03"])
    partials.write_partials(small(spark, march=False), SCOPE, marts, ["2017-03"])
    assert not any("2017-03" in at for at in [*files(folder), *files(marts)])
    mp = read_marketplace_parquet(spark, folder)
    assert {r.order_id for r in mp.orders.collect()} == {"o1", "o2"}
    assert partials.exec_kpis(partials.read_partials(spark, marts)).first().total_orders == 2


def test_an_order_that_moved_is_refused(spark, tmp_path):
    folder = str(tmp_path / "tables")
    write_canonical(small(spark), folder)
    moved = small(spark, [order("o1", "c1", "2017-03-01 10:00:00")])
    moved = moved.__class__(**{**moved.__dict__, "orders": moved.orders.filter(
        "order_id <> 'o1' or order_purchase_timestamp >= timestamp_ntz'2017-03-01 00:00:00'")})
    before = files(folder)
    with pytest.raises(ValueError, match="o1"):
        reload_months(moved, folder, ["2017-03"])
    assert files(folder) == before
    reload_months(moved, folder, ["2017-01", "2017-03"])
    assert {r.purchase_month for r in read_marketplace_parquet(spark, folder).orders.filter(
        "order_id = 'o1'").collect()} == {"2017-03"}


def test_partials_of_the_driver_tables(spark, tmp_path):
    mp, scope = from_driver_tables(spark, SF), registered_scope("exec_kpis")
    marts = str(tmp_path / "marts")
    partials.write_partials(mp, scope, marts)
    parts = partials.read_partials(spark, marts)
    for got, want in [(partials.rfm_base(parts, scope), rfm.rfm_base(mp, scope)),
                      (partials.regional_performance(parts), kpis.regional_performance(mp, scope)),
                      (partials.category_performance(parts, scope), kpis.category_performance(mp, scope)),
                      (partials.monthly_revenue_trend(parts), kpis.monthly_revenue_trend(mp, scope))]:
        assert compare(got.toPandas(), want.toPandas()) == (True, "ok")


def test_sketches_merge_within_their_error(spark):
    """300,000 persons over 12 months: beyond the size where sketches are exact."""
    rows = spark.range(900_000).select(
        F.concat(F.lit("2017-"), F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0")).alias("purchase_month"),
        (F.col("id") % 300_000).alias("customer_unique_id"), F.lit("SP").alias("customer_state"), "id")
    parts = {"person_months": rows.groupBy("purchase_month", "customer_unique_id", "customer_state").agg(
                 F.count("id").alias("orders")),
             "sketch_months": rows.groupBy("purchase_month", "customer_state").agg(
                 F.hll_sketch_agg("customer_unique_id", F.lit(partials.LG_K)).alias("customers"),
                 F.hll_sketch_agg("id", F.lit(partials.LG_K)).alias("orders"))}
    got = {(r.dimension, r.member): r for r in partials.distinct_counts(parts).collect()}
    assert len(got) == 14 and got["total", "all"].customers == 300_000
    bound = partials.SKETCH_ERRORS * partials.SKETCH_ERROR
    for r in got.values():
        assert abs(r.customers_estimate - r.customers) <= bound * r.customers
        assert abs(r.orders_estimate - r.orders) <= bound * r.orders
    assert any(r.customers_estimate != r.customers for r in got.values())
