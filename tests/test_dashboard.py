"""BI-6: the long dashboard relation against the queries behind its visuals."""


from repeatlens.catalog import registered_scope
from repeatlens.parity import compare, duckdb_connection, same_representation
from repeatlens.plans import bi, dashboard, kpis, rfm, targeting
from repeatlens.sources.driver_adapter import from_driver_tables

SF = "/root/testdata/sf0.001"


def cells(df, visual):
    return {(r.row_key, r.measure): r.value for r in df.filter(df.visual == visual).collect()}


def wide(df, key, measures):
    return {(str(r[key]) if key else "all", m): float(r[m]) for r in df.collect() for m in measures
            if r[m] is not None}


def test_equals_the_single_queries(spark):
    mp, scope = from_driver_tables(spark, SF), registered_scope("dashboard_datasets")
    d = dashboard.dashboard_datasets(mp, scope)
    assert set(r.page for r in d.select("page").distinct().collect()) == {
        dashboard.OVERVIEW, dashboard.CUSTOMERS, dashboard.MODEL}
    k = kpis.exec_kpis(mp, scope)
    assert cells(d, "kpi_cards") == wide(k, None, k.columns)
    m = kpis.monthly_revenue_trend(mp, scope)
    assert cells(d, "monthly_trend") == wide(m, "order_month", m.columns[1:])
    s = bi.revenue_concentration(mp, scope)
    got = cells(d, "top_states")
    assert {x: got[x] for x in wide(s, "customer_state", s.columns[1:])} == wide(
        s, "customer_state", s.columns[1:])
    c = kpis.category_performance(mp, scope)
    assert cells(d, "top_categories") == wide(c, "category", c.columns[1:])
    g = rfm.rfm_segment_summary(mp, scope)
    assert cells(d, "segments") == wide(g, "segment", g.columns[1:])
    o = rfm.one_time_vs_repeat(mp, scope)
    assert cells(d, "one_time_buyers") == wide(o, None, o.columns)
    t = targeting.top_decile_lift(mp, scope)
    assert cells(d, "targeting") == {("payment_value", m): v for (_, m), v in wide(
        t, None, t.columns).items()}


def test_equals_the_oracle(spark):
    from repeatlens import catalog, oracle
    a = catalog.queries()["dashboard_datasets"](spark, SF).toPandas()
    b = duckdb_connection(SF).execute(oracle.build()["dashboard_datasets"]).df()
    assert compare(a, b) == (True, "ok") and same_representation(a, b) == (True, "ok")


def test_orders_without_items_and_categories(spark):
    """They count as buyers, not as sales; unnamed categories have no row."""
    mp, scope = from_driver_tables(spark, SF), registered_scope("dashboard_datasets")
    mp = mp.__class__(**{**mp.__dict__, "order_items": mp.order_items.filter("order_id % 3 <> 0"),
                         "category_translation": mp.category_translation.limit(2)})
    d = dashboard.dashboard_datasets(mp, scope)
    k = kpis.exec_kpis(mp, scope)
    assert cells(d, "kpi_cards") == wide(k, None, k.columns)
    o = rfm.one_time_vs_repeat(mp, scope)
    assert cells(d, "one_time_buyers") == wide(o, None, o.columns)
    c = kpis.category_performance(mp, scope)
    assert len({x for x, _ in cells(d, "top_categories")}) == 2
    assert cells(d, "top_categories") == wide(c, "category", c.columns[1:])
