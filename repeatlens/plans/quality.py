"""DQ-1..7: data-quality checks that fix the scope of every later job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.functions.columns import month_label, round_half, pct
from repeatlens.scope import Scope
from repeatlens.sources.tables import Marketplace


def null_delivery(mp: Marketplace, scope: Scope | None = None) -> DataFrame:
    """Missing delivery dates per status (non-delivered statuses explain them)."""
    return mp.orders.groupBy("order_status").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(F.col("order_delivered_customer_date").isNull()).alias("missing_delivery_date"),
    )


def date_range(mp: Marketplace, scope: Scope | None = None) -> DataFrame:
    return mp.orders.agg(
        F.min("order_purchase_timestamp").alias("first_purchase"),
        F.max("order_purchase_timestamp").alias("last_purchase"),
        F.count(F.lit(1)).alias("orders"),
    )


def status_counts(mp: Marketplace, scope: Scope | None = None) -> DataFrame:
    """Orders per status and their share (the window runs over the statuses)."""
    from pyspark.sql import Window

    g = mp.orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("orders"))
    return g.select("order_status", "orders",
                    round_half(pct("orders", F.sum("orders").over(Window.partitionBy())), 1)
                    .alias("share_pct"))


def duplicate_orders(mp: Marketplace, scope: Scope | None = None) -> DataFrame:
    """order_id values that occur more than once (expected: none)."""
    return (mp.orders.groupBy("order_id").agg(F.count(F.lit(1)).alias("c"))
            .filter(F.col("c") > 1))


def monthly_volume(mp: Marketplace, scope: Scope | None = None) -> DataFrame:
    """Orders per month with a partial-edge-month signal.

    ``pct_of_median`` compares each month with the median month; the first
    and last months are flagged, since a collection window that starts or
    ends mid-month shows up there as a low-volume edge.  The window runs
    over the monthly aggregate, which is bounded by the calendar span.
    """
    from pyspark.sql import Window

    m = (mp.orders.groupBy(month_label("order_purchase_timestamp").alias("month"))
         .agg(F.count(F.lit(1)).alias("orders")))
    allw = Window.partitionBy()
    return m.select(
        "month", F.col("orders").cast("bigint").alias("orders"),
        (F.col("month") == F.min("month").over(allw)).alias("is_first_month"),
        (F.col("month") == F.max("month").over(allw)).alias("is_last_month"),
        round_half(pct("orders", F.median("orders").over(allw)), 1).alias("pct_of_median"),
    ).orderBy("month")


def customer_key_grain(mp: Marketplace, scope: Scope | None = None) -> DataFrame:
    """Distinct per-order ids vs per-person ids: proves the key trap."""
    c = mp.customers
    return c.agg(
        F.count_distinct("customer_id").alias("order_level_ids"),
        F.count_distinct("customer_unique_id").alias("person_level_ids"),
        F.count(F.lit(1)).alias("rows"),
    )


def row_counts(mp: Marketplace, scope: Scope | None = None) -> DataFrame:
    """Rows per canonical table (one small aggregate per table, unioned)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
             for name, df in mp.tables().items()]
    return reduce(DataFrame.unionByName, parts)
