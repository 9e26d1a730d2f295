"""HYP-1..4: cohort-controlled comparisons of one-time and repeat buyers.

HYP-1/3/4 start from ``cohort.cohort`` (first eligible order + full-window
frequency, one aggregate); HYP-2 from ``cohort.first_item_and_frequency``
(first purchased item + frequency, one aggregate).  Review and payment
rows are rolled up to one row per order *before* they meet the cohort,
and the reference's row-level averages are rebuilt from per-order counts
and sums, so the result equals the fan-out join's averages without
materialising the fan-out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.functions.columns import (customer_type, pct, round_half, safe_ratio,
                                          seconds_between)
from repeatlens.plans.base import child_rows, product_categories
from repeatlens.plans.cohort import cohort, first_item_and_frequency
from repeatlens.scope import Scope
from repeatlens.sources.tables import Marketplace


def reviews_per_order(mp: Marketplace, scope: Scope) -> DataFrame:
    r = child_rows(mp, "order_reviews", scope)
    return r.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("review_rows"),
        F.count("review_score").alias("n_scores"),
        F.sum("review_score").alias("sum_score"),
    )


def payments_per_order(mp: Marketplace, scope: Scope) -> DataFrame:
    p = child_rows(mp, "order_payments", scope)
    return p.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("payment_rows"),
        F.count("payment_installments").alias("n_inst"),
        F.sum("payment_installments").alias("sum_inst"),
        F.count("payment_value").alias("n_value"),
        F.sum("payment_value").alias("sum_value"),
    )


def delivery(mp: Marketplace, scope: Scope) -> DataFrame:
    """HYP-1: review score and delivery timing by customer type.

    ``customers`` counts rows of the first-order x review LEFT JOIN (an order
    with k reviews counts k times), as the reference does; the averages are
    weighted the same way.  ``distinct_customers`` gives the person count.
    """
    c = cohort(mp, scope, ["order_delivered_customer_date", "order_estimated_delivery_date"]) \
        .join(reviews_per_order(mp, scope), "order_id", "left")
    w = F.greatest(F.coalesce(F.col("review_rows"), F.lit(0)), F.lit(1))
    dsec = seconds_between("order_purchase_timestamp", "order_delivered_customer_date")
    lsec = seconds_between("order_estimated_delivery_date", "order_delivered_customer_date")
    g = c.groupBy(customer_type("frequency").alias("customer_type")).agg(
        F.sum(w).alias("customers"),
        F.count(F.lit(1)).alias("distinct_customers"),
        F.sum("sum_score").alias("sum_score"),
        F.sum("n_scores").alias("n_scores"),
        F.sum(dsec * w).alias("dsec"), F.sum(F.when(dsec.isNotNull(), w)).alias("dn"),
        F.sum(lsec * w).alias("lsec"), F.sum(F.when(lsec.isNotNull(), w)).alias("ln"),
    )
    return g.select(
        "customer_type",
        F.col("customers").cast("bigint").alias("customers"),
        F.col("distinct_customers").cast("bigint").alias("distinct_customers"),
        round_half(safe_ratio("sum_score", "n_scores"), 2).alias("avg_review_score"),
        round_half(safe_ratio("dsec", F.lit(86400.0) * F.col("dn").cast("double")), 1)
        .alias("avg_delivery_days"),
        round_half(safe_ratio("lsec", F.lit(86400.0) * F.col("ln").cast("double")), 1)
        .alias("avg_days_early_or_late"),
    )


def category(mp: Marketplace, scope: Scope) -> DataFrame:
    """HYP-2: repeat rate by category of the first purchased item (>= min buyers)."""
    fi = first_item_and_frequency(mp, scope).join(product_categories(mp), "product_id")
    g = fi.groupBy("category").agg(
        F.count_if(F.col("frequency") == 1).alias("one_time"),
        F.count_if(F.col("frequency") > 1).alias("repeat"),
        F.count(F.lit(1)).alias("total_first_time_buyers"),
    )
    return (g.filter(F.col("total_first_time_buyers") >= scope.min_category_buyers)
            .select("category", "one_time", "repeat",
                    round_half(pct("repeat", "total_first_time_buyers"), 1).alias("repeat_rate_pct"),
                    "total_first_time_buyers")
            .orderBy(F.desc("repeat_rate_pct"), "category"))


def payment(mp: Marketplace, scope: Scope) -> DataFrame:
    """HYP-3: instalments and payment value per payment row, by customer type."""
    c = cohort(mp, scope, payload=[]).join(payments_per_order(mp, scope), "order_id")
    g = c.groupBy(customer_type("frequency").alias("customer_type")).agg(
        F.sum("payment_rows").alias("payment_rows"),
        F.sum("sum_inst").alias("sum_inst"), F.sum("n_inst").alias("n_inst"),
        F.sum("sum_value").alias("sum_value"), F.sum("n_value").alias("n_value"),
    )
    return g.select(
        "customer_type",
        F.col("payment_rows").cast("bigint").alias("payment_rows"),
        round_half(safe_ratio("sum_inst", "n_inst"), 2).alias("avg_installments"),
        round_half(safe_ratio("sum_value", "n_value"), 2).alias("avg_payment_value"),
    )


def geography(mp: Marketplace, scope: Scope) -> DataFrame:
    """HYP-4: repeat rate by state of the first order (>= min customers)."""
    g = cohort(mp, scope, ["customer_state"]).groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("frequency") > 1).alias("repeat"),
    )
    return (g.filter(F.col("customers") >= scope.min_state_customers)
            .select("customer_state", "customers",
                    round_half(pct("repeat", "customers"), 1).alias("repeat_rate_pct"))
            .orderBy(F.desc("repeat_rate_pct"), "customer_state"))
