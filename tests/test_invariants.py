"""Arithmetic invariants and reference points on the driver data (FIXTURES.md B)."""

import os

import pytest

from repeatlens.plans import bi, kpis, quality, rfm
from repeatlens.scope import driver_scope
from repeatlens.sources.driver_adapter import from_driver_tables

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


@pytest.fixture(scope="module")
def mp(spark):
    return from_driver_tables(spark, SF)


def test_reference_points_sf001(mp):
    s = driver_scope()
    k = kpis.exec_kpis(mp, s).collect()[0]
    assert (k.total_orders, k.total_customers) == (758, 589)
    assert k.total_revenue == pytest.approx(163709509.36)
    assert k.avg_order_value == pytest.approx(215975.61)
    assert k.total_freight == pytest.approx(6542388.63)
    o = rfm.one_time_vs_repeat(mp, s).collect()[0]
    assert (o.one_time_customers, o.repeat_customers, o.customers) == (459, 138, 597)
    seg = {r.segment: r.customers for r in rfm.rfm_segment_summary(mp, s).collect()}
    assert seg == {"Champions": 111, "High Value At Risk": 78, "Needs Attention": 169,
                   "Recent, Lower Spend": 126, "Lost / Low Value": 105}


def test_segments_sum_to_customers_and_revenue(mp):
    s = driver_scope()
    k = kpis.exec_kpis(mp, s).collect()[0]
    seg = rfm.rfm_segment_summary(mp, s).collect()
    assert sum(r.customers for r in seg) == k.total_customers
    assert sum(r.total_monetary for r in seg) == pytest.approx(k.total_revenue, abs=0.01)
    assert sum(r.share_of_revenue_pct for r in seg) == pytest.approx(100.0, abs=0.3)


def test_statuses_sum_to_orders(mp):
    st = quality.status_counts(mp).collect()
    dr = quality.date_range(mp).collect()[0]
    assert sum(r.orders for r in st) == dr.orders


def test_breakdowns_sum_to_total(mp):
    m = bi.measure_by_dimension(mp, driver_scope()).toPandas()
    total = m[m.dimension == "total"].total_revenue.iloc[0]
    for dim in ("state", "category", "month"):
        assert m[m.dimension == dim].total_revenue.sum() == pytest.approx(total, rel=1e-12)
    assert bi.row_count_reconciliation(mp, driver_scope()).collect()[0].matches


def test_null_delivery_count(mp):
    rows = {r.order_status: r for r in quality.null_delivery(mp).collect()}
    assert rows["delivered"].orders == 4933
    assert rows["delivered"].missing_delivery_date == 74


def test_targeting_with_prebuilt_feature_mart(spark, mp):
    from repeatlens.parity import compare
    from repeatlens.plans import features, targeting
    from repeatlens.session import materialize

    s = driver_scope()
    mart = materialize(features.features_imputed(mp, s))
    for fn in (targeting.roc_auc_rank, targeting.top_decile_lift, targeting.classification_report):
        ok, msg = compare(fn(mp, s, features=mart).toPandas(), fn(mp, s).toPandas())
        assert ok, (fn.__name__, msg)
