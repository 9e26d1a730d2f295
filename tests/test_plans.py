"""Plan guards: the physical shapes the scale design depends on."""

import os

import pytest

from repeatlens.catalog import queries

SF = "/root/testdata/sf0.01"
ML = {"cv_model_comparison", "feature_importances", "final_model_evaluation", "final_confusion_matrix",
      "grid_search"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def plan_of(spark, name: str) -> str:
    return queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in queries() if n not in ML])
def test_no_cross_or_python_row_udf(spark, name):
    plan = plan_of(spark, name)
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, f"{name} plans {bad}"


def test_kpis_push_window_filter_and_avoid_expand(spark):
    plan = plan_of(spark, "exec_kpis")
    assert "Expand" not in plan
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


@pytest.mark.parametrize("name", ["first_orders", "customer_freq", "hyp_delivery", "hyp_category",
                                  "hyp_payment", "hyp_geography", "order_top_category"])
def test_first_per_person_is_an_aggregate_not_a_window(spark, name):
    assert "Window" not in plan_of(spark, name)


def test_topk_limits_before_the_shuffle(spark):
    plan = plan_of(spark, "top_products_per_category")
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "TakeOrderedAndProject" in plan


def test_global_rank_is_range_partitioned(spark):
    plan = plan_of(spark, "stratified_folds")
    assert "row_number()" not in plan          # no single-partition window numbering
    assert "monotonically_increasing_id" in plan


@pytest.mark.parametrize("name", ["rfm_scores", "rfm_describe"])
def test_selected_ranks_need_no_order(spark, name):
    plan = plan_of(spark, name)
    assert "row_number()" not in plan and "rangepartitioning" not in plan.lower()
    assert "monotonically_increasing_id" not in plan
