"""BI-6: the tables behind the three dashboard pages as one long relation.

``dashboard_datasets`` reads orders, items, customers and products once:
scoped orders with their person, state and month, and the items rolled up to
one row per (order, category), leave that scan as grouping sets -- an order
level and an order x category level -- and every visual of the overview and
customer pages is an aggregate of those two levels.  A visual that ran its own
query would scan and join the same tables again; there are a dozen of them.

The customer page scores the persons that the order level adds up to, and the
model page rates the hold-out customers by what they paid, the deterministic
score of the targeting checks (a fitted model's figures come from
``plans.modeling``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatlens.functions.columns import (month_label, pct, round_half, safe_ratio, seconds_between,
                                          to_double, ts_lit, with_scalars)
from repeatlens.plans import rfm, targeting
from repeatlens.plans.base import child_rows, scoped_orders, with_person
from repeatlens.plans.features import label_frame
from repeatlens.scope import Scope
from repeatlens.session import write_shared
from repeatlens.sources.tables import Marketplace

OVERVIEW, CUSTOMERS, MODEL = "Executive Overview", "Customer Intelligence", "Model Insights"


def dashboard_cells(mp: Marketplace, scope: Scope) -> DataFrame:
    """The scoped sales at two levels, written once.

    ``level`` 'order': one row per order (order_id, person, state, month, ts)
    with items, revenue and freight (null without items); 'category': the
    same per English category of the order's items, where they have one.
    Both levels combine before the shuffle.
    """
    orders = with_person(
        scoped_orders(mp, scope, cols=["order_id", "customer_id", "order_purchase_timestamp"]),
        mp, state=True).select(
            "order_id", F.col("customer_unique_id").alias("person"),
            F.col("customer_state").alias("state"), F.col("order_purchase_timestamp").alias("ts"))
    names = mp.category_translation.select(
        "product_category_name", F.col("product_category_name_english").alias("category"))
    products = mp.products.select("product_id", "product_category_name").join(
        names, "product_category_name").select("product_id", "category")
    items = child_rows(mp, "order_items", scope).select(
        "order_id", "product_id", "price", "freight_value", F.lit(1).alias("item"))
    rows = orders.join(items.join(products, "product_id", "left"), "order_id", "left")
    keys = ["order_id", "person", "state", "ts"]
    cells = rows.groupingSets([keys, [*keys, "category"]], *keys, "category").agg(
        F.grouping("category").alias("whole"), F.sum("price").alias("revenue"),
        F.sum("freight_value").alias("freight"), F.count("item").alias("items"))
    return write_shared(
        cells.filter("whole = 1 or category is not null").select(
            F.when(F.col("whole") == 1, "order").otherwise("category").alias("level"),
            *keys, month_label("ts").alias("month"), "category", "revenue", "freight", "items"),
        "dashboard-cells")


def _long(df: DataFrame, page: str, visual: str, key: Column | str, measures: list[str]) -> DataFrame:
    """Wide rows as (page, visual, row_key, measure, value), nulls left out."""
    key = F.col(key) if isinstance(key, str) else key
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), to_double(m).alias("value")) for m in measures])
    return (df.select(key.cast("string").alias("row_key"), F.explode(cells).alias("c"))
            .select(F.lit(page).alias("page"), F.lit(visual).alias("visual"), "row_key",
                    "c.measure", "c.value").filter(F.col("value").isNotNull()))


def _breakdowns(cells: DataFrame) -> DataFrame:
    """Orders, revenue and freight by month, by state, by person and state,
    and in total: one pass over the order level."""
    sold = cells.filter("level = 'order'")
    sets = [["month"], ["state", "person"]]
    return write_shared(sold.groupingSets(sets, "month", "state", "person").agg(
        F.grouping("month").alias("no_month"), F.count_if(F.col("items") > 0).alias("orders"),
        F.count(F.lit(1)).alias("all_orders"), F.sum("revenue").alias("revenue"),
        F.sum("freight").alias("freight"),
        F.max(F.when(F.col("items") > 0, F.col("ts"))).alias("last")), "dashboard-groups")


def dashboard_datasets(mp: Marketplace, scope: Scope) -> DataFrame:
    """(page, visual, row_key, measure, value): every number of the dashboard.

    Overview: KPI cards, monthly trend, states and top categories; customers:
    segments and one-time buyers; model: targeting by what was paid.  Windows
    run over months, states and segments, which do not grow with the data.
    """
    cells = dashboard_cells(mp, scope)
    groups = _breakdowns(cells)
    by_person = groups.filter("no_month = 1")
    persons = by_person.groupBy("person").agg(
        F.sum("orders").alias("frequency"), F.sum("all_orders").alias("all_orders"),
        F.sum("revenue").alias("monetary"), F.sum("freight").alias("freight"),
        F.max("last").alias("last"))
    persons = write_shared(persons, "dashboard-persons")

    # overview
    totals = persons.agg(
        F.coalesce(F.sum("frequency"), F.lit(0)).alias("total_orders"),
        F.count_if(F.col("frequency") > 0).alias("total_customers"), F.sum("monetary").alias("total_revenue"),
        F.sum("freight").alias("freight"), F.count_if(F.col("all_orders") == 1).alias("one_time_customers"),
        F.count_if(F.col("all_orders") > 1).alias("repeat_customers"), F.count(F.lit(1)).alias("customers"))
    totals = totals.select(
        "*", round_half(safe_ratio("total_revenue", "total_orders"), 2).alias("avg_order_value"),
        round_half(to_double("freight"), 2).alias("total_freight"),
        round_half(pct("freight", "total_revenue"), 1).alias("freight_share_pct"),
        round_half(pct("one_time_customers", "customers"), 1).alias("pct_one_time"))
    before = F.lag("revenue").over(Window.orderBy("month"))
    months = groups.filter("no_month = 0 and orders > 0").select(
        "month", "orders", "revenue", (F.col("revenue") - before).alias("mom_change"),
        round_half(pct(F.col("revenue") - before, before), 1).alias("mom_growth_pct"))
    by_state = by_person.filter("orders > 0").groupBy("state").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("orders").alias("orders"),
        F.sum("revenue").alias("sum"))
    by_state = with_scalars(by_state.withColumn("revenue", to_double("sum")),
                            totals.select("total_customers"))
    order = Window.orderBy(F.desc("revenue"), "state")
    whole = F.sum("revenue").over(Window.partitionBy())
    upto = F.sum("revenue").over(order.rowsBetween(Window.unboundedPreceding, 0))
    states = by_state.select(
        "state", "customers", "orders", "revenue", F.row_number().over(order).alias("revenue_rank"),
        round_half(safe_ratio("revenue", "orders"), 2).alias("avg_order_value"),
        round_half(pct("customers", "total_customers"), 1).alias("share_customers_pct"),
        round_half(pct("revenue", whole), 1).alias("share_revenue_pct"),
        round_half(pct(upto, whole), 1).alias("cumulative_revenue_pct"))
    categories = (cells.filter("level = 'category'").groupBy("category").agg(
        F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("orders"))
        .orderBy(F.desc("revenue"), "category").limit(scope.top_categories)
        .withColumn("avg_order_value", round_half(safe_ratio("revenue", "orders"), 2)))

    # customers
    secs = seconds_between("last", ts_lit(scope.snapshot))
    base = persons.filter("frequency > 0").select(
        F.col("person").alias("customer_unique_id"),
        (secs.cast("double") / F.lit(86400.0)).cast("int").alias("recency_days"),
        F.col("frequency").cast("bigint"), to_double("monetary").alias("monetary"))
    segments = rfm.segment_summary(rfm.score(base))

    # model page: the hold-out customers rated by what they paid
    rated = write_shared(label_frame(mp, scope), "dashboard-labels")
    pages = [
        _long(totals, OVERVIEW, "kpi_cards", F.lit("all"), [
            "total_orders", "total_customers", "total_revenue", "avg_order_value", "total_freight",
            "freight_share_pct"]),
        _long(months, OVERVIEW, "monthly_trend", "month", [
            "orders", "revenue", "mom_change", "mom_growth_pct"]),
        _long(states, OVERVIEW, "top_states", "state", [
            "customers", "orders", "revenue", "avg_order_value", "revenue_rank",
            "share_customers_pct", "share_revenue_pct", "cumulative_revenue_pct"]),
        _long(categories, OVERVIEW, "top_categories", "category", [
            "revenue", "orders", "avg_order_value"]),
        _long(segments, CUSTOMERS, "segments", "segment", [
            "customers", "avg_monetary", "total_monetary", "share_of_revenue_pct"]),
        _long(totals, CUSTOMERS, "one_time_buyers", F.lit("all"), [
            "one_time_customers", "repeat_customers", "customers", "pct_one_time"]),
        _long(targeting.roc_auc_rank(mp, scope, rated), MODEL, "score", F.lit("payment_value"), [
            "auc", "positives", "negatives"]),
        _long(targeting.top_decile_lift(mp, scope, rated), MODEL, "targeting", F.lit("payment_value"), [
            "cutoff", "flagged", "hits", "baseline_rate", "flagged_rate", "lift"]),
        _long(targeting.classification_report(mp, scope, rated), MODEL, "report", "class", [
            "precision", "recall", "f1", "support"]),
    ]
    return reduce(DataFrame.unionByName, pages)
