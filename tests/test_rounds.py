"""Header-driven CSV, nothing dropped silently, pruned child tables, report errors."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from repeatlens.operators import evaluation as ev
from repeatlens.plans import bi, features, kpis, modeling
from repeatlens.plans.sql_scripts import run_sql
from repeatlens.scope import Scope, driver_scope
from repeatlens.sources.csv_source import (ingest_to_parquet, read_csv_table,
                                           read_marketplace_parquet, write_canonical)
from repeatlens.sources.driver_adapter import from_driver_tables
from tests.builders import SCOPE, market, order
from tests.test_sources import RAW

SF = "/root/testdata/sf0.001"


def _file(text, name="order_items.csv"):
    path = os.path.join(tempfile.mkdtemp(prefix="repeatlens-csv-"), name)
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_csv_columns_are_found_by_their_names(spark):
    path = _file("order_id,freight_value,extra,price,order_item_id,product_id,seller_id,"
                 "shipping_limit_date\no1,2.25,x,10.50,1,p1,s1,2017-02-05 00:00:00\n")
    row = read_csv_table(spark, path, "order_items").collect()[0]
    assert (float(row.price), float(row.freight_value), row.order_item_id) == (10.5, 2.25, 1)
    assert "extra" not in row.asDict()


def test_csv_without_a_column_is_refused(spark):
    with pytest.raises(ValueError, match="price"):
        read_csv_table(spark, _file("order_id,freight_value\no1,1\n"), "order_items")


def _mp(spark, payments=(("o1", "credit_card", 2, 10),)):
    orders = [order("o1", "c1", "2017-01-05 10:00:00"), order("o2", "c2", "2017-02-05 10:00:00"),
              order("o3", "c3", "2017-04-01 10:00:00")]
    items = [("o1", 1, "p1", "s", 10, 1), ("o2", 1, "p1", "s", 20, 2), ("o3", 1, "p1", "s", 5, 1)]
    cust = [("c1", "u1", "SP"), ("c2", "u2", "SP"), ("c3", "u1", "RJ")]
    return market(spark, orders, items, cust, [("p1", "cat")], [("cat", "cat_en")], payments,
                  [("o1", 4)])


def test_customers_without_payment_stay_in_the_model_frame(spark):
    mp = _mp(spark)
    rows = {r.customer_unique_id: r for r in modeling.model_frame(mp, SCOPE).collect()}
    assert set(rows) == {"u1", "u2"}
    assert (rows["u2"].no_payment, rows["u2"].payment_value) == (1, 0.0)
    assert (rows["u1"].no_payment, rows["u1"].payment_value) == (0, 10.0)
    check = modeling.model_frame_row_check(mp, SCOPE).collect()[0]
    assert (check.feature_rows, check.model_rows, check.without_payment) == (2, 2, 1)


def test_levels_have_no_cap_of_their_own(spark):
    df = spark.range(10_050).select(F.concat(F.lit("v"), "id").alias("x"))
    assert len(features.checked_levels(df, "x")) == 10_050


def test_auc_counts_unscored_rows_and_is_exact(spark):
    df = spark.createDataFrame([(1, 3.0), (0, 1.0), (0, 3.0), (1, None), (0, None), (0, None)],
                               "y int, s double")
    r = ev.roc_auc(df, "y", "s").collect()[0]
    assert (r.auc, r.positives, r.negatives, r.unscored) == (0.75, 1, 2, 3)
    by = {r.g: r for r in ev.roc_auc(df.withColumn("g", F.lit(7)), "y", "s", group="g").collect()}
    assert by[7].auc == 0.75 and by[7].unscored == 3


def test_empty_scope_has_no_orders(spark):
    r = kpis.exec_kpis(_mp(spark), SCOPE.with_(status="lost")).collect()[0]
    assert (r.total_orders, r.total_customers, r.total_revenue) == (0, 0, None)


def test_category_script_without_quantity(spark):
    mp = _mp(spark)
    assert "quantity" not in mp.order_items.columns
    got = run_sql(spark, mp, SCOPE, "hyp_category", "nq_").collect()
    assert [(r.category, r.one_time, r["repeat"]) for r in got] == [("cat_en", 1, 1)]


def test_calendar_month_keeps_days_without_sales(spark):
    got = bi.sales_by_calendar_month(_mp(spark), SCOPE).collect()
    assert [(r.year_month, r.days, r.days_with_sales, r.orders, r.revenue) for r in got] == [
        ("2017-01", 27, 1, 1, 10.0), ("2017-02", 28, 1, 1, 20.0), ("2017-03", 31, 0, 0, 0.0),
        ("2017-04", 1, 1, 1, 5.0)]


def test_star_keys_match_the_fact(spark):
    mp = from_driver_tables(spark, SF)
    s = driver_scope()
    fact, dims = bi.fact_sales(mp, s), bi.star_dimensions(mp, s)
    for key, dim in (("customer_unique_id", "dim_customers"), ("product_id", "dim_products")):
        assert fact.join(dims[dim], key, "left_anti").count() == 0
        assert dims[dim].groupBy(key).count().filter("count > 1").count() == 0


def test_child_tables_are_pruned_and_results_equal(spark):
    from repeatlens.catalog import JOBS

    mp, s = from_driver_tables(spark, SF), driver_scope()
    out = tempfile.mkdtemp(prefix="repeatlens-children-")
    write_canonical(mp, out)
    stored = read_marketplace_parquet(spark, out)
    for t in ("order_items", "order_payments", "order_reviews"):
        assert "purchase_month" in getattr(stored, t).columns
        assert getattr(stored, t).count() == getattr(mp, t).count()
    for name in ("exec_kpis", "category_performance", "hyp_delivery", "hyp_category",
                 "hyp_payment", "order_top_category", "customer_features", "fact_sales"):
        df = JOBS[name](stored, s)
        assert sorted(map(str, df.collect())) == sorted(map(str, JOBS[name](mp, s).collect())), name
    plan = JOBS["customer_features"](stored, s)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan") if "purchase_month" in x]
    assert len({t for t in ("orders", "order_items", "order_payments", "order_reviews")
                for x in scans if f"/{t}]" in x}) == 4
    assert all("PartitionFilters: [isnotnull(purchase_month" in x for x in scans)


def test_an_order_in_two_months_is_refused(spark):
    orders = [order("o1", "c1", "2017-01-05 10:00:00"), order("o1", "c1", "2017-03-05 10:00:00")]
    mp = market(spark, orders, [("o1", 1, "p1", "s", 1, 0)], [("c1", "u1", "SP")])
    out = tempfile.mkdtemp(prefix="repeatlens-two-")
    with pytest.raises(ValueError, match="several months"):
        write_canonical(mp, out)
    write_canonical(mp, out, by_month=False)


def test_ingest_by_month_keeps_all_rows(spark):
    folder = tempfile.mkdtemp(prefix="repeatlens-raw-")
    files = {}
    for name, text in RAW.items():
        files[name] = f"my_{name}.csv"
        with open(os.path.join(folder, files[name]), "w") as fh:
            fh.write(text)
    out = tempfile.mkdtemp(prefix="repeatlens-pq-")
    audit = {r.table: r.rows for r in ingest_to_parquet(spark, folder, out, files).collect()}
    stored = read_marketplace_parquet(spark, out)
    assert all(df.count() == audit[n] for n, df in stored.tables().items())


def test_report_names_what_failed(spark):
    from repeatlens.report import ReportError, run_report, scope_from

    out = tempfile.mkdtemp(prefix="repeatlens-report-")
    one = market(spark, [order("o1", "c1", "2017-01-05 10:00:00")],
                 [("o1", 1, "p1", "s", 10, 1)], [("c1", "u1", "SP")], [("p1", "cat")],
                 [("cat", "cat_en")])
    with pytest.raises(ReportError) as e:  # one customer has no five recency classes
        run_report(spark, one, SCOPE, out)
    assert isinstance(e.value.result["rfm_scores"], str)
    assert isinstance(e.value.result["exec_kpis"], float)
    assert scope_from(["status=shipped", "top_categories=3"]) == Scope(status="shipped",
                                                                      top_categories=3)
    with pytest.raises(ValueError):
        scope_from(["colour=red"])


def test_no_machine_local_folder_off_local_masters():
    from repeatlens.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        Context.master = master
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            ensure_checkpoint_dir(Session())
