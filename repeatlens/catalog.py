"""Registry of the analyses runnable on the driver tables.

Each entry is ``(spark, sf_dir) -> DataFrame``; the canonical tables are
derived lazily from the driver Parquet files and the driver scope.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repeatlens.scope import Scope, driver_cohort_scope, driver_full_scope
from repeatlens.sources.driver_adapter import from_driver_tables
from repeatlens.sources.tables import Marketplace
from repeatlens.plans import (bi, cohort, dashboard, features, hypothesis, kpis, modeling, partials,
                              quality, rfm, targeting)

Job = Callable[[Marketplace, Scope], DataFrame]

JOBS: dict[str, Job] = {
    "exec_kpis": kpis.exec_kpis,
    "monthly_revenue_trend": kpis.monthly_revenue_trend,
    "regional_performance": kpis.regional_performance,
    "category_performance": kpis.category_performance,
    "top_products_per_category": kpis.top_products_per_category,
    "dq_null_delivery": quality.null_delivery,
    "dq_date_range": quality.date_range,
    "dq_status_counts": quality.status_counts,
    "dq_duplicate_orders": quality.duplicate_orders,
    "dq_monthly_volume": quality.monthly_volume,
    "dq_customer_key_grain": quality.customer_key_grain,
    "dq_row_counts": quality.row_counts,
    "rfm_base": rfm.rfm_base,
    "rfm_describe": rfm.rfm_describe,
    "one_time_vs_repeat": rfm.one_time_vs_repeat,
    "first_orders": cohort.first_orders,
    "customer_freq": cohort.customer_freq,
    "hyp_delivery": hypothesis.delivery,
    "hyp_category": hypothesis.category,
    "hyp_payment": hypothesis.payment,
    "hyp_geography": hypothesis.geography,
    "order_top_category": cohort.order_top_category,
    "rfm_scores": rfm.rfm_scores,
    "rfm_segments": rfm.rfm_segments,
    "rfm_segment_summary": rfm.rfm_segment_summary,
    "customer_features": features.customer_features,
    "features_imputed": features.features_imputed,
    "target_balance": features.target_balance,
    "features_null_report": features.features_null_report,
    "features_one_hot": features.features_one_hot,
    "class_weights": targeting.class_weights,
    "stratified_folds": targeting.stratified_folds,
    "stratified_split": targeting.stratified_split,
    "roc_auc_rank": targeting.roc_auc_rank,
    "confusion_matrix": targeting.confusion_matrix,
    "classification_report": targeting.classification_report,
    "top_decile_lift": targeting.top_decile_lift,
    "revenue_concentration": bi.revenue_concentration,
    "date_dim": bi.date_dim,
    "fact_sales": bi.fact_sales,
    "measure_by_dimension": bi.measure_by_dimension,
    "row_count_reconciliation": bi.row_count_reconciliation,
    "sales_by_calendar_month": bi.sales_by_calendar_month,
    "kpis_from_partials": partials.kpis_from_partials,
    "distinct_sketches": partials.distinct_sketches,
    "dashboard_datasets": dashboard.dashboard_datasets,
    "model_frame_row_check": modeling.model_frame_row_check,
    "model_fold_sizes": modeling.model_fold_sizes,
    "feature_matrix": modeling.feature_matrix,
    "feature_moments": modeling.feature_moments,
    "dummy_baseline": modeling.dummy_baseline,
    # model jobs: rows-only checks (tree learners are not SQL)
    "cv_model_comparison": modeling.cv_model_comparison,
    "feature_importances": modeling.feature_importances,
    "final_model_evaluation": modeling.final_model_evaluation,
    "final_confusion_matrix": modeling.final_confusion_matrix,
    "logistic_regression": modeling.logistic_regression,
    "grid_search": modeling.grid_search,
}


#: Jobs without a cohort; the others need an end of the time to reorder.  All cover all months.
FULL_SPAN = {
    "exec_kpis", "monthly_revenue_trend", "regional_performance", "category_performance",
    "top_products_per_category", "rfm_base", "rfm_describe", "rfm_scores", "rfm_segments",
    "rfm_segment_summary", "revenue_concentration", "date_dim", "fact_sales",
    "measure_by_dimension", "row_count_reconciliation", "sales_by_calendar_month",
    "kpis_from_partials", "distinct_sketches",
}


def registered_scope(name: str) -> Scope:
    """The driver-table scope that a query is registered with."""
    return driver_full_scope() if name in FULL_SPAN else driver_cohort_scope()


def portable(df: DataFrame) -> DataFrame:
    """Render timestamp/date columns as ISO strings.

    Engines hand timestamps to pandas with different units (ns vs us), so a
    value hash over raw datetimes differs even when the values agree; the
    registered queries therefore return ``yyyy-MM-dd HH:mm:ss`` text (the
    library functions themselves stay typed)."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd HH:mm:ss").alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _bind(name: str, job: Job) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(job(from_driver_tables(spark, sf_dir), registered_scope(name)))

    run.__name__ = job.__name__
    run.__doc__ = job.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(name, job) for name, job in JOBS.items()}
