"""Executive KPIs, monthly trend, regional and category performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatlens.functions.columns import (month_label, round_half, safe_ratio, pct,
                                          to_double)
from repeatlens.plans.base import (child_rows, order_totals, product_categories, scoped_orders,
                                   with_person)
from repeatlens.scope import Scope
from repeatlens.sources.tables import Marketplace


def _orders_with_revenue(mp: Marketplace, scope: Scope, state: bool = False) -> DataFrame:
    """Scoped orders that have items, with order revenue/freight and person key."""
    o = scoped_orders(mp, scope, cols=["order_id", "customer_id", "order_purchase_timestamp"])
    return with_person(o.join(order_totals(mp, scope), "order_id"), mp, state=state)


def customer_orders(mp: Marketplace, scope: Scope) -> DataFrame:
    """Per person: last purchase, distinct orders, revenue, freight (items joined)."""
    return _orders_with_revenue(mp, scope).groupBy("customer_unique_id").agg(
        F.max("order_purchase_timestamp").alias("last_order_date"),
        F.count_distinct("order_id").alias("frequency"),
        F.sum("order_revenue").alias("monetary"),
        F.sum("order_freight").alias("freight"),
    )


def exec_kpis(mp: Marketplace, scope: Scope) -> DataFrame:
    """Orders, customers, revenue, AOV and freight for the scope.

    Rolled up person-first: each order belongs to one person, so the total
    of per-person distinct orders is the distinct order count, and the
    global step aggregates one row per person -- no multi-distinct Expand.
    """
    per_person = customer_orders(mp, scope)
    agg = per_person.agg(
        F.coalesce(F.sum("frequency"), F.lit(0)).alias("total_orders"),  # an empty scope has none
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("monetary").alias("revenue"),
        F.sum("freight").alias("freight"),
    )
    return agg.select(
        F.col("total_orders").cast("bigint").alias("total_orders"),
        F.col("total_customers").cast("bigint").alias("total_customers"),
        to_double("revenue").alias("total_revenue"),
        round_half(safe_ratio("revenue", "total_orders"), 2).alias("avg_order_value"),
        round_half(to_double("freight"), 2).alias("total_freight"),
        round_half(pct("freight", "revenue"), 1).alias("freight_share_pct"),
    )


def monthly_revenue_trend(mp: Marketplace, scope: Scope) -> DataFrame:
    """Revenue and orders per 'YYYY-MM' with month-over-month change and %.

    The LAG window runs over the monthly aggregate (one row per calendar
    month), so its single partition is bounded by the time span, not data.
    """
    o = scoped_orders(mp, scope, cols=["order_id", "order_purchase_timestamp"])
    monthly = (o.join(order_totals(mp, scope).select("order_id", "order_revenue"), "order_id")
               .groupBy(month_label("order_purchase_timestamp").alias("order_month"))
               .agg(F.sum("order_revenue").alias("revenue"),
                    F.count_distinct("order_id").alias("orders")))
    prev = F.lag("revenue").over(Window.orderBy("order_month"))
    return monthly.select(
        "order_month",
        to_double("revenue").alias("revenue"),
        F.col("orders").cast("bigint").alias("orders"),
        to_double(F.col("revenue") - prev).alias("mom_change"),
        round_half(pct(F.col("revenue") - prev, prev), 1).alias("mom_growth_pct"),
    ).orderBy("order_month")


def state_person(mp: Marketplace, scope: Scope) -> DataFrame:
    """(state, person) grain: distinct orders and revenue."""
    return (_orders_with_revenue(mp, scope, state=True)
            .groupBy("customer_state", "customer_unique_id")
            .agg(F.count_distinct("order_id").alias("n_orders"),
                 F.sum("order_revenue").alias("revenue")))


def regional_performance(mp: Marketplace, scope: Scope) -> DataFrame:
    """Per customer state: distinct customers and orders, revenue, AOV.

    Two-level aggregate: (state, person) first, then state.  A hot state
    (one state held 42 % of customers upstream) is absorbed by the partial
    aggregation of the second level.
    """
    st = state_person(mp, scope).groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("n_orders").alias("orders"),
        F.sum("revenue").alias("revenue"))
    return st.select(
        "customer_state",
        F.col("customers").cast("bigint").alias("customers"),
        F.col("orders").cast("bigint").alias("orders"),
        to_double("revenue").alias("revenue"),
        round_half(safe_ratio("revenue", "orders"), 2).alias("avg_order_value"),
    ).orderBy(F.desc("revenue"), "customer_state")


def _category_orders(mp: Marketplace, scope: Scope) -> DataFrame:
    """(category, order_id, product_id, revenue) at item-aggregate grain."""
    o = scoped_orders(mp, scope, cols=["order_id"])
    items = child_rows(mp, "order_items", scope).select("order_id", "product_id", "price")
    return (o.join(items, "order_id")
            .join(product_categories(mp), "product_id"))


def category_performance(mp: Marketplace, scope: Scope) -> DataFrame:
    """Top categories by revenue with distinct orders and AOV."""
    per_order = (_category_orders(mp, scope)
                 .groupBy("category", "order_id")
                 .agg(F.sum(F.col("price").cast("decimal(18,2)")).alias("revenue")))
    cat = per_order.groupBy("category").agg(
        F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    return (cat.select(
        "category",
        to_double("revenue").alias("revenue"),
        F.col("orders").cast("bigint").alias("orders"),
        round_half(safe_ratio("revenue", "orders"), 2).alias("avg_order_value"),
    ).orderBy(F.desc("revenue"), "category").limit(scope.top_categories))


def top_products_per_category(mp: Marketplace, scope: Scope) -> DataFrame:
    """Top-k products per category by revenue (RANK, gaps on ties), then a
    global top-N.  ``rank <= k`` after the window lets Catalyst insert a
    partial WindowGroupLimit before the shuffle, so a category holding a
    third of all products ships only its local top-k rows per partition."""
    prod = (_category_orders(mp, scope)
            .groupBy("category", "product_id")
            .agg(F.sum(F.col("price").cast("decimal(18,2)")).alias("revenue")))
    w = Window.partitionBy("category").orderBy(F.desc("revenue"))
    ranked = prod.withColumn("rank_in_category", F.rank().over(w))
    return (ranked.filter(F.col("rank_in_category") <= scope.top_products_per_category)
            .select("category", "product_id", to_double("revenue").alias("revenue"),
                    F.col("rank_in_category").cast("int").alias("rank_in_category"))
            .orderBy(F.desc("revenue"), "category", "product_id")
            .limit(scope.top_products_total))
