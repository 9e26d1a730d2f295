"""SNK-3, AGG-3: per-month partial aggregates that add up to the marts.

Three partial marts are kept, a directory per month: person x state totals,
category totals, and distinct-count sketches by state.  They are mergeable --
sums, maxima and unions -- so the marts of any span of months come from them
alone, and a changed month is recomputed by itself.  Distinct customers add
up exactly through their keys, or within ``SKETCH_ERRORS`` standard errors
through the sketches, whose size does not depend on the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repeatlens.functions.columns import (month_label, pct, round_half, safe_ratio, seconds_between,
                                          to_double, ts_lit)
from repeatlens.plans.base import (child_rows, order_totals, product_categories, scoped_orders,
                                   with_person)
from repeatlens.scope import Scope
from repeatlens.session import shared_path
from repeatlens.sources.incremental import overwrite_months
from repeatlens.sources.tables import Marketplace

#: Sketches of 2^LG_K registers; the standard error of an estimate is about
#: 1.04 / sqrt(2^LG_K), and of this many ones an estimate stays within.
LG_K, SKETCH_ERRORS = 12, 5
SKETCH_ERROR = 1.04 / 2 ** (LG_K / 2)
NAMES = ("person_months", "category_months", "sketch_months")


def month_partials(mp: Marketplace, scope: Scope, months: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The partial marts of the scope, or of some of its months."""
    o = scoped_orders(mp, scope, cols=["order_id", "customer_id", "order_purchase_timestamp"])
    o = o.withColumn("purchase_month", month_label("order_purchase_timestamp"))
    if months is not None:
        o = o.filter(F.col("purchase_month").isin(*months))
    orders = with_person(o, mp, state=True)
    sold = orders.join(order_totals(mp, scope), "order_id", "left")
    has = F.col("order_item_count").isNotNull()
    persons = sold.groupBy("purchase_month", "customer_unique_id", "customer_state").agg(
        F.count_distinct(F.when(has, F.col("order_id"))).alias("orders"),
        F.count_distinct("order_id").alias("all_orders"),
        F.sum("order_revenue").alias("revenue"), F.sum("order_freight").alias("freight"),
        F.max(F.when(has, F.col("order_purchase_timestamp"))).alias("last_order_date"))
    items = child_rows(mp, "order_items", scope).select("order_id", "product_id", "price")
    categories = (o.select("order_id", "purchase_month").join(items, "order_id")
                  .join(product_categories(mp), "product_id")
                  .groupBy("purchase_month", "category").agg(
                      F.sum("price").alias("revenue"), F.count_distinct("order_id").alias("orders")))
    sketches = sold.filter(has).groupBy("purchase_month", "customer_state").agg(
        F.hll_sketch_agg("customer_unique_id", F.lit(LG_K)).alias("customers"),
        F.hll_sketch_agg("order_id", F.lit(LG_K)).alias("orders"))
    return dict(zip(NAMES, (persons, categories, sketches)))


def write_partials(mp: Marketplace, scope: Scope, folder: str, months: Sequence[str] | None = None) -> None:
    """Write all partial marts, or replace the given months of them."""
    for name, df in month_partials(mp, scope, months).items():
        path = f"{folder.rstrip('/')}/{name}"
        if months is None:
            df.hint("rebalance", "purchase_month").write.mode("overwrite").partitionBy(
                "purchase_month").parquet(path)
        else:
            overwrite_months(df.hint("rebalance", "purchase_month"), path, months)


def read_partials(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.option("basePath", f"{folder.rstrip('/')}/{n}")
            .parquet(f"{folder.rstrip('/')}/{n}")
            .withColumn("purchase_month", F.col("purchase_month").cast("string")) for n in NAMES}


def _persons(parts: dict[str, DataFrame]) -> DataFrame:
    return parts["person_months"].groupBy("customer_unique_id").agg(
        F.sum("orders").alias("frequency"), F.sum("all_orders").alias("all_orders"),
        F.sum("revenue").alias("monetary"), F.sum("freight").alias("freight"),
        F.max("last_order_date").alias("last_order_date"))


def exec_kpis(parts: dict[str, DataFrame]) -> DataFrame:
    """QA-1 from the partial marts."""
    agg = _persons(parts).filter("frequency > 0").agg(
        F.coalesce(F.sum("frequency"), F.lit(0)).alias("total_orders"), F.count(F.lit(1)).alias("n"),
        F.sum("monetary").alias("revenue"), F.sum("freight").alias("freight"))
    return agg.select(
        F.col("total_orders").cast("bigint"), F.col("n").alias("total_customers"),
        to_double("revenue").alias("total_revenue"),
        round_half(safe_ratio("revenue", "total_orders"), 2).alias("avg_order_value"),
        round_half(to_double("freight"), 2).alias("total_freight"),
        round_half(pct("freight", "revenue"), 1).alias("freight_share_pct"))


def monthly_revenue_trend(parts: dict[str, DataFrame]) -> DataFrame:
    """QA-2 from the partial marts; the window runs over the months."""
    m = parts["person_months"].filter("orders > 0").groupBy(F.col("purchase_month").alias("order_month")).agg(
        F.sum("revenue").alias("rev"), F.sum("orders").cast("bigint").alias("orders"))
    before = F.lag("rev").over(Window.orderBy("order_month"))
    change = F.col("rev") - before
    return m.select("order_month", to_double("rev").alias("revenue"), "orders",
                    to_double(change).alias("mom_change"),
                    round_half(pct(change, before), 1).alias("mom_growth_pct")).orderBy("order_month")


def regional_performance(parts: dict[str, DataFrame]) -> DataFrame:
    """QA-3 from the partial marts."""
    per = parts["person_months"].filter("orders > 0").groupBy("customer_state", "customer_unique_id").agg(
        F.sum("orders").alias("orders"), F.sum("revenue").alias("rev"))
    st = per.groupBy("customer_state").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("orders").cast("bigint").alias("orders"),
        F.sum("rev").alias("rev"))
    return st.select("customer_state", "customers", "orders", to_double("rev").alias("revenue"),
                     round_half(safe_ratio("rev", "orders"), 2).alias("avg_order_value")
                     ).orderBy(F.desc("revenue"), "customer_state")


def category_performance(parts: dict[str, DataFrame], scope: Scope) -> DataFrame:
    """QA-4 from the partial marts: an order lies in one month."""
    c = parts["category_months"].groupBy("category").agg(
        F.sum("revenue").alias("rev"), F.sum("orders").cast("bigint").alias("orders"))
    return c.select("category", to_double("rev").alias("revenue"), "orders",
                    round_half(safe_ratio("rev", "orders"), 2).alias("avg_order_value")
                    ).orderBy(F.desc("revenue"), "category").limit(scope.top_categories)


def rfm_base(parts: dict[str, DataFrame], scope: Scope) -> DataFrame:
    """QA-6 from the partial marts."""
    secs = seconds_between("last_order_date", ts_lit(scope.snapshot))
    return _persons(parts).filter("frequency > 0").select(
        "customer_unique_id", (secs.cast("double") / F.lit(86400.0)).cast("int").alias("recency_days"),
        F.col("frequency").cast("bigint"), to_double("monetary").alias("monetary"))


def distinct_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """AGG-3: distinct customers and orders by month, by state and in total,
    exactly and by sketches: (dimension, member, customers, orders,
    customers_estimate, orders_estimate)."""
    def by_set(df: DataFrame, *aggs) -> DataFrame:
        sets = [["purchase_month"], ["customer_state"], []]
        g = df.groupingSets(sets, "purchase_month", "customer_state").agg(F.grouping_id().alias("gid"), *aggs)
        named = F.when(F.col("gid") == 1, "month").when(F.col("gid") == 2, "state").otherwise("total")
        member = F.when(F.col("gid") == 1, F.col("purchase_month")).when(
            F.col("gid") == 2, F.col("customer_state").cast("string")).otherwise("all")
        return g.select(named.alias("dimension"), F.coalesce(member, F.lit("")).alias("member"),
                        *[c for c in g.columns if c not in ("gid", "purchase_month", "customer_state")])

    exact = by_set(parts["person_months"].filter("orders > 0"),
                   F.count_distinct("customer_unique_id").alias("customers"),
                   F.sum("orders").cast("bigint").alias("orders"))
    near = by_set(parts["sketch_months"],
                  F.hll_sketch_estimate(F.hll_union_agg("customers")).alias("customers_estimate"),
                  F.hll_sketch_estimate(F.hll_union_agg("orders")).alias("orders_estimate"))
    return exact.join(near, ["dimension", "member"], "full")


def _built(mp: Marketplace, scope: Scope) -> dict[str, DataFrame]:
    spark = mp.orders.sparkSession
    folder = shared_path(spark, "partials")
    write_partials(mp, scope, folder)
    return read_partials(spark, folder)


def kpis_from_partials(mp: Marketplace, scope: Scope) -> DataFrame:
    """QA-1 by way of the stored month partials."""
    return exec_kpis(_built(mp, scope))


def distinct_sketches(mp: Marketplace, scope: Scope) -> DataFrame:
    """AGG-3: exact distinct counts, and whether the sketches' estimates lie
    within their stated error."""
    bound = SKETCH_ERRORS * SKETCH_ERROR

    def within(c: str):
        gap = F.abs(F.col(f"{c}_estimate") - F.col(c)).cast("double")
        return (gap <= F.lit(bound) * F.col(c).cast("double")).alias(f"{c}_within")

    return distinct_counts(_built(mp, scope)).select(
        "dimension", "member", "customers", "orders", within("customers"), within("orders"))
