"""BI-1..6: star-schema marts and dashboard datasets.

The fact table is scoped once (status + window) at item grain and every
measure is an aggregate over it, so a breakdown by any dimension sums back
to the grand total -- the scope cannot be lost between a measure and a
dimension the way a separate filter on a dimension table can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatlens.functions.columns import (month_label, pct, round_half, to_double,
                                          total_revenue, weekday_sun0, with_scalars,
                                          year_month_sort)
from repeatlens.plans.base import child_rows, scoped_orders, with_person
from repeatlens.plans.kpis import exec_kpis, regional_performance, state_person
from repeatlens.scope import Scope
from repeatlens.sources.tables import Marketplace


def date_key(ts) -> "F.Column":
    """Integer day key yyyymmdd: equal grain on both sides of a date join."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def revenue_concentration(mp: Marketplace, scope: Scope) -> DataFrame:
    """BI-1: state shares of customers and revenue with cumulative share.

    Windows run over the per-state aggregate (one row per state)."""
    st = regional_performance(mp, scope)
    # total persons from the same (state, person) aggregate: one chain, reused
    tot = state_person(mp, scope).agg(F.count_distinct("customer_unique_id").alias("total_customers"))
    j = with_scalars(st, tot)
    allw = Window.partitionBy()
    order = Window.orderBy(F.desc("revenue"), "customer_state")
    cum = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return j.select(
        "customer_state", "customers", "revenue",
        F.row_number().over(order).cast("int").alias("revenue_rank"),
        round_half(pct("customers", "total_customers"), 1).alias("share_customers_pct"),
        round_half(pct("revenue", F.sum("revenue").over(allw)), 1).alias("share_revenue_pct"),
        round_half(pct(F.sum("revenue").over(cum), F.sum("revenue").over(allw)), 1)
        .alias("cumulative_revenue_pct"),
    )


def fact_sales(mp: Marketplace, scope: Scope) -> DataFrame:
    """BI-3: scoped item-grain fact with person, state, category and date keys."""
    o = scoped_orders(mp, scope, cols=["order_id", "customer_id", "order_purchase_timestamp"])
    o = with_person(o, mp, state=True)
    ct = mp.category_translation.select(
        "product_category_name", F.col("product_category_name_english").alias("category"))
    prod = mp.products.select("product_id", "product_category_name").join(
        ct, "product_category_name", "left").select("product_id", "category")
    items = child_rows(mp, "order_items", scope).select("order_id", "order_item_id", "product_id", "seller_id", "price",
                                  "freight_value")
    return (o.join(items, "order_id").join(prod, "product_id", "left")
            .select("order_id", "order_item_id", "product_id", "seller_id", "customer_unique_id",
                    "customer_state", "category",
                    F.date_trunc("day", "order_purchase_timestamp").cast("timestamp_ntz")
                    .alias("order_date"),
                    date_key("order_purchase_timestamp").alias("date_key"),
                    year_month_sort("order_purchase_timestamp").alias("year_month_sort"),
                    F.col("price").cast("double").alias("price"),
                    F.col("freight_value").cast("double").alias("freight_value")))


def date_dim(mp: Marketplace, scope: Scope) -> DataFrame:
    """BI-2: one row per calendar day spanned by the scoped orders.

    ``date`` is a midnight TIMESTAMP_NTZ and ``date_key`` an integer, so
    facts join on the day grain, never on a timestamp with a time part.

    ``sequence`` expands a date range inside one row; its length is the
    number of days in the span, which does not grow with the data."""
    o = scoped_orders(mp, scope, cols=["order_purchase_timestamp"])
    span = o.agg(F.to_date(F.min("order_purchase_timestamp")).alias("d0"),
                 F.to_date(F.max("order_purchase_timestamp")).alias("d1"))
    d = span.select(F.explode(F.sequence("d0", "d1")).alias("d"))
    ts = F.col("d").cast("timestamp_ntz")
    return d.select(ts.alias("date"), date_key(ts).alias("date_key"),
                    F.year("d").alias("year"), F.month("d").alias("month"),
                    F.dayofmonth("d").alias("day"), month_label(ts).alias("year_month"),
                    year_month_sort(ts).alias("year_month_sort"),
                    weekday_sun0(ts).alias("weekday"))


def sales_by_calendar_month(mp: Marketplace, scope: Scope) -> DataFrame:
    """JN-12 / SRT-7: the fact joined with the date dimension on the day key,
    by month in calendar order; days without sales count as days."""
    f = fact_sales(mp, scope).groupBy("date_key").agg(
        F.count_distinct("order_id").alias("orders"), F.count(F.lit(1)).alias("items"),
        total_revenue("price").alias("revenue"))
    by_day = date_dim(mp, scope).select("date_key", "year_month", "year_month_sort").join(
        f, "date_key", "left")
    return by_day.groupBy("year_month_sort", "year_month").agg(
        F.count(F.lit(1)).alias("days"), F.count("orders").alias("days_with_sales"),
        F.coalesce(F.sum("orders"), F.lit(0)).cast("bigint").alias("orders"),
        F.coalesce(F.sum("items"), F.lit(0)).cast("bigint").alias("items"),
        F.coalesce(to_double(F.sum("revenue")), F.lit(0.0)).alias("revenue"),
    ).orderBy("year_month_sort")


def star_dimensions(mp: Marketplace, scope: Scope) -> dict[str, DataFrame]:
    """SNK-3: the dimensions beside the fact, on its keys: persons, products
    with their English category, and payments and reviews per scoped order."""
    orders = scoped_orders(mp, scope, cols=["order_id", "customer_id", "order_purchase_timestamp"])
    keys = orders.select("order_id").distinct()
    ct = mp.category_translation.select(
        "product_category_name", F.col("product_category_name_english").alias("category"))
    persons = with_person(orders, mp, state=True).groupBy("customer_unique_id").agg(
        F.max(F.struct("order_purchase_timestamp", "order_id", "customer_state")).alias("last"))
    return {
        "dim_customers": persons.select("customer_unique_id", F.col("last.customer_state")
                                        .alias("last_state")),
        "dim_products": mp.products.select("product_id", "product_category_name").join(
            ct, "product_category_name", "left").select("product_id", "category"),
        "order_payments": child_rows(mp, "order_payments", scope).join(keys, "order_id", "left_semi"),
        "order_reviews": child_rows(mp, "order_reviews", scope).join(keys, "order_id", "left_semi"),
    }


def measure_by_dimension(mp: Marketplace, scope: Scope) -> DataFrame:
    """BI-4: Total Revenue by state, category and month, plus the grand total.

    Every breakdown is a grouping of the same scoped fact, so each sums to
    the grand total (categories without a translation show as 'unknown')."""
    f = fact_sales(mp, scope).select(
        F.col("customer_state").alias("state"),
        F.coalesce(F.col("category"), F.lit("unknown")).alias("category"),
        F.col("year_month_sort").cast("string").alias("month"),
        "price")
    # the fact is rolled up to its (state, category, month) cells first: the
    # grouping sets then expand cells, not item rows
    cells = f.groupBy("state", "category", "month").agg(total_revenue("price").alias("rev"))
    g = cells.groupingSets([["state"], ["category"], ["month"], []], "state", "category", "month") \
        .agg(F.sum("rev").alias("rev"), F.grouping_id().alias("gid"))
    dim = (F.when(F.col("gid") == 3, F.lit("state")).when(F.col("gid") == 5, F.lit("category"))
           .when(F.col("gid") == 6, F.lit("month")).otherwise(F.lit("total")))
    member = (F.when(F.col("gid") == 3, F.col("state")).when(F.col("gid") == 5, F.col("category"))
              .when(F.col("gid") == 6, F.col("month")).otherwise(F.lit("all")))
    return g.select(dim.alias("dimension"), member.alias("member"), to_double("rev").alias("total_revenue"))


def row_count_reconciliation(mp: Marketplace, scope: Scope) -> DataFrame:
    """BI-5: scoped fact orders/revenue vs the independent KPI query."""
    f = fact_sales(mp, scope).agg(F.count_distinct("order_id").alias("fact_orders"),
                                  F.sum(F.col("price").cast("decimal(18,2)")).alias("fact_revenue"))
    k = exec_kpis(mp, scope).select("total_orders", "total_revenue")
    j = with_scalars(f, k)
    return j.select(F.col("fact_orders").cast("bigint"), F.col("total_orders").alias("sql_orders"),
                    to_double("fact_revenue").alias("fact_revenue"),
                    F.col("total_revenue").alias("sql_revenue"),
                    ((F.col("fact_orders") == F.col("total_orders"))
                     & (to_double("fact_revenue") == F.col("total_revenue"))).alias("matches"))


def write_dashboard_marts(mp: Marketplace, scope: Scope, out_dir: str, fmt: str = "parquet",
                          include_models: bool = False, model_params=None) -> dict[str, str]:
    """BI-6 / SNK-3: write the tables behind the three dashboard pages.

    Overview: KPI cards, monthly trend, states, categories; customer page:
    segments and the one-time share; model page (optional, slow): model
    comparison, importances and lift.  The fact and date dimension are
    written too, the fact partitioned by month for pruning."""
    from repeatlens.plans import kpis, rfm
    from repeatlens.sources.sinks import write_table

    marts = {
        "kpi_cards": kpis.exec_kpis(mp, scope),
        "monthly_trend": kpis.monthly_revenue_trend(mp, scope),
        "top_states": revenue_concentration(mp, scope),
        "top_categories": kpis.category_performance(mp, scope),
        "rfm_segments": rfm.rfm_segments(mp, scope),
        "segment_summary": rfm.rfm_segment_summary(mp, scope),
        "one_time_vs_repeat": rfm.one_time_vs_repeat(mp, scope),
        "date_dim": date_dim(mp, scope),
        "sales_by_calendar_month": sales_by_calendar_month(mp, scope),
        **star_dimensions(mp, scope),
    }
    if include_models:
        from repeatlens.plans import modeling

        from repeatlens.session import materialize

        mpar = model_params or modeling.ModelParams()
        frame = materialize(modeling.model_frame(mp, scope, mpar))  # built once, read by 3 jobs
        marts["model_comparison"] = modeling.cv_model_comparison(mp, scope, mpar, frame)
        marts["feature_importances"] = modeling.feature_importances(mp, scope, mpar, frame=frame)
        marts["model_lift"] = modeling.final_model_evaluation(mp, scope, mpar, frame)
    paths = {}
    for name, df in marts.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        write_table(df, path, fmt)
        paths[name] = path
    path = f"{out_dir.rstrip('/')}/fact_sales"
    write_table(fact_sales(mp, scope), path, fmt, partition_by=["year_month_sort"])
    paths["fact_sales"] = path
    return paths
