"""SQL entry point over registered views, and the dashboard mart writer."""

import os
import tempfile

from repeatlens.plans import bi, kpis
from tests.builders import SCOPE, market, order

CT = [("cat_a", "a_en")]
PRODUCTS = [("p1", "cat_a"), ("p2", None)]


def _mp(spark):
    orders = [order("o1", "c1", "2017-02-01 10:00:00"), order("o2", "c2", "2017-03-01 10:00:00"),
              order("o3", "c3", "2017-04-01 10:00:00")]
    items = [("o1", 1, "p1", "s", 10, 1), ("o2", 1, "p2", "s", 20, 2), ("o3", 1, "p1", "s", 5, 1)]
    cust = [("c1", "u1", "SP"), ("c2", "u1", "SP"), ("c3", "u2", "RJ")]
    return market(spark, orders, items, cust, PRODUCTS, CT,
                  [("o1", "credit_card", 2, 10), ("o3", "boleto", 1, 5)], [("o1", 4)])


def test_spark_sql_over_views_equals_job(spark):
    mp = _mp(spark)
    mp.register_views(prefix="t_")
    sql = """
    WITH done AS (SELECT order_id, customer_id FROM t_orders WHERE order_status = 'delivered'
                  AND year(order_purchase_timestamp) IN (2017, 2018)),
         worth AS (SELECT order_id, sum(price) AS amount FROM t_order_items GROUP BY order_id)
    SELECT customer_state, count(*) AS orders, double(sum(amount)) AS revenue
    FROM done NATURAL JOIN worth NATURAL JOIN t_customers GROUP BY customer_state"""
    a = {r.customer_state: (r.orders, r.revenue) for r in spark.sql(sql).collect()}
    b = {r.customer_state: (r.orders, r.revenue)
         for r in kpis.regional_performance(mp, SCOPE).collect()}
    assert a == b and len(a) == 2


def test_write_dashboard_marts(spark):
    mp = _mp(spark)
    out = tempfile.mkdtemp(prefix="repeatlens-marts-")
    paths = bi.write_dashboard_marts(mp, SCOPE, out)
    assert {"kpi_cards", "monthly_trend", "top_states", "rfm_segments", "date_dim", "fact_sales"} <= set(paths)
    kpi = spark.read.parquet(paths["kpi_cards"]).collect()[0]
    assert kpi.total_revenue == 35.0
    fact = spark.read.parquet(paths["fact_sales"])
    assert fact.count() == 3 and "year_month_sort" in fact.columns
    assert any(n.startswith("year_month_sort=") for n in os.listdir(paths["fact_sales"]))


def test_run_report_writes_every_analysis(spark):
    from repeatlens.catalog import JOBS
    from repeatlens.report import MODEL_JOBS, run_report

    mp = _mp(spark)
    out = tempfile.mkdtemp(prefix="repeatlens-report-")
    t = run_report(spark, mp, SCOPE, out)
    expected = {n for n in JOBS if n not in MODEL_JOBS} | {"dashboard_marts"}
    assert set(t) == expected
    assert spark.read.parquet(f"{out}/exec_kpis").collect()[0].total_revenue == 35.0
