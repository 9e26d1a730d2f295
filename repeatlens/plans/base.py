"""Scoped building blocks shared by the analytics jobs.

Scale notes: the scope filter (status + half-open window) is applied to
``orders`` before any join, so it reaches the Parquet scan.  Item-level
facts are pre-aggregated to order grain *before* they meet the person
key, so the person-level shuffle moves one row per order, not per item,
and a customer holding a third of all orders is absorbed by partial
aggregation instead of landing whole in one task.

Copies: order counts stay ``count(DISTINCT order_id)``, as upstream, so
duplicated order rows are counted once.  Spark plans a single distinct
as (key, order_id) -> key; both levels combine map-side, so copies of one
order -- even a third of all rows -- collapse before either shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repeatlens.functions.columns import ts_lit
from repeatlens.scope import Scope
from repeatlens.sources.tables import Marketplace

ORDER_COLS = ["order_id", "customer_id", "order_purchase_timestamp",
              "order_delivered_customer_date", "order_estimated_delivery_date"]


def _months(scope: Scope, end: str) -> Column:
    """The bounds that the window implies for a ``purchase_month`` column."""
    last = F.date_format(F.timestamp_add("SECOND", F.lit(-1), ts_lit(end)), "yyyy-MM")
    first = F.date_format(ts_lit(scope.window_start), "yyyy-MM")
    return (F.col("purchase_month") >= first) & (F.col("purchase_month") <= last)


def child_rows(mp: Marketplace, name: str, scope: Scope) -> DataFrame:
    """``order_items``, ``order_payments`` or ``order_reviews`` of the scope's months.

    Ingested tables carry the month of their order as a partition column, so
    only the window's directories are read and shuffled; the join with the
    scoped orders still decides which rows count.  Other tables pass whole.
    """
    df = getattr(mp, name)
    if "purchase_month" not in df.columns:
        return df
    return df.filter(_months(scope, scope.window_end)).drop("purchase_month")


def scoped_orders(mp: Marketplace, scope: Scope, end: str | None = None,
                  cols: list[str] | None = None) -> DataFrame:
    """Orders with the scope status purchased in [window_start, end)."""
    end = end or scope.window_end
    o = mp.orders
    cond = ((F.col("order_status") == F.lit(scope.status))
            & (F.col("order_purchase_timestamp") >= ts_lit(scope.window_start))
            & (F.col("order_purchase_timestamp") < ts_lit(end)))
    if "purchase_month" in o.columns:
        # month-partitioned storage: the implied month bounds prune directories
        cond = cond & _months(scope, end)
    return o.filter(cond).select(*(cols or ORDER_COLS))


def order_totals(mp: Marketplace, scope: Scope) -> DataFrame:
    """Item facts rolled up to one row per order.

    Sums stay at the columns' own decimal scale (freight may carry more
    than two digits); rounding happens once, at the output edge.
    """
    return child_rows(mp, "order_items", scope).groupBy("order_id").agg(
        F.sum("price").alias("order_revenue"),
        F.sum("freight_value").alias("order_freight"),
        F.count(F.lit(1)).alias("order_item_count"),
    )


def with_person(orders: DataFrame, mp: Marketplace, state: bool = False) -> DataFrame:
    """Attach the person key (and optionally the state) through customer_id."""
    cols = ["customer_id", "customer_unique_id"] + (["customer_state"] if state else [])
    return orders.join(mp.customers.select(*cols), "customer_id")


def product_categories(mp: Marketplace) -> DataFrame:
    """product_id -> English category; NULL or untranslated categories drop out.

    No broadcast hint: the translation table is user data without a proven
    bound, so the strategy is left to AQE, which broadcasts only after
    measuring the side under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    ct = mp.category_translation.select(
        "product_category_name", F.col("product_category_name_english").alias("category"))
    return (mp.products.select("product_id", "product_category_name")
            .join(ct, "product_category_name")
            .select("product_id", "category"))
