"""COH-1/2 and FEA-1: first eligible orders, full-window frequency, top category.

"First order per person" is computed as an aggregate --
``min(struct(purchase_ts, order_id, payload...))`` grouped by person --
instead of ``row_number()`` over a person window.  The aggregate is
combined map-side, so a person holding a third of all orders costs one
partial row per map task; the window would sort all of that person's
rows in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.functions.columns import ts_lit
from repeatlens.plans.base import child_rows, product_categories, scoped_orders, with_person
from repeatlens.scope import Scope
from repeatlens.sources.tables import Marketplace

FIRST_COLS = ["order_id", "order_purchase_timestamp", "order_delivered_customer_date",
              "order_estimated_delivery_date", "customer_state"]


def person_orders(mp: Marketplace, scope: Scope,
                  payload: list[str] | None = FIRST_COLS) -> DataFrame:
    """Per person over the full window: frequency and the first order.

    ``payload`` lists the first order's columns to carry (``order_id`` and
    the purchase time always come along); ``None`` skips the first order.
    Column pruning cannot look inside the aggregate's struct, so a job
    asks only for what it reads -- e.g. no delivery dates for the state
    or payment comparison.  ``eligible`` says whether the first order
    precedes ``eligible_before``; since the eligibility window shares its
    start with the full window, the earliest eligible order *is* the
    earliest order whenever it exists.
    """
    order_key = ["order_purchase_timestamp", "order_id"]  # struct order = sort order
    extra = [c for c in (payload or []) if c not in order_key]
    order_cols = [c for c in extra if c != "customer_state"]
    o = with_person(scoped_orders(mp, scope, cols=["order_id", "customer_id", *order_key[:1], *order_cols]),
                    mp, state="customer_state" in extra)
    aggs = [F.count_distinct("order_id").alias("frequency")]
    if payload is not None:
        aggs.append(F.min(F.struct(*order_key, *extra)).alias("f"))
    agg = o.groupBy("customer_unique_id").agg(*aggs)
    cols = ["customer_unique_id", F.col("frequency").cast("bigint").alias("frequency")]
    if payload is not None:
        cols += [F.col(f"f.{c}").alias(c) for c in ["order_id", "order_purchase_timestamp", *extra]]
        cols.append((F.col("f.order_purchase_timestamp") < ts_lit(scope.eligible_before)).alias("eligible"))
    return agg.select(*cols)


def customer_freq(mp: Marketplace, scope: Scope) -> DataFrame:
    """COH-2: scoped order count per person (no item join)."""
    return person_orders(mp, scope, payload=None)


def first_orders(mp: Marketplace, scope: Scope) -> DataFrame:
    """COH-1: first order per person, for persons whose first order is eligible."""
    return (person_orders(mp, scope).filter("eligible")
            .select("customer_unique_id", *FIRST_COLS))


def cohort(mp: Marketplace, scope: Scope, payload: list[str] = FIRST_COLS) -> DataFrame:
    """First eligible order (``order_id``, purchase time + ``payload``) with
    its person's full-window frequency."""
    po = person_orders(mp, scope, payload)
    keep = ["order_id", "order_purchase_timestamp"] + [c for c in payload
                                                         if c not in ("order_id", "order_purchase_timestamp")]
    return po.filter("eligible").select("customer_unique_id", "frequency", *keep)


def first_item_product(mp: Marketplace, scope: Scope) -> DataFrame:
    """First purchased item per person among eligible item-bearing orders.

    Items are joined before the first order is chosen, so orders without
    items never count as 'first'.  The item inside that order is the one
    with the lowest (order_item_id, product_id, seller_id, price, quantity)
    -- a deterministic choice where the reference left it arbitrary.
    """
    o = with_person(scoped_orders(mp, scope, end=scope.eligible_before,
                                  cols=["order_id", "customer_id", "order_purchase_timestamp"]), mp)
    items = child_rows(mp, "order_items", scope)
    qty = [F.col("quantity")] if "quantity" in items.columns else []
    it = o.join(items.select("order_id", "order_item_id", "product_id", "seller_id", "price", *qty),
                "order_id")
    key = F.struct("order_purchase_timestamp", "order_id", "order_item_id", "product_id",
                   "seller_id", "price", *qty)
    return (it.groupBy("customer_unique_id").agg(F.min(key).alias("k"))
            .select("customer_unique_id", F.col("k.order_id").alias("order_id"),
                    F.col("k.product_id").alias("product_id")))


def first_item_and_frequency(mp: Marketplace, scope: Scope) -> DataFrame:
    """Frequency and first purchased item per person from one aggregate.

    Items are first rolled up to each order's first item (lowest item id,
    product, seller, price, quantity) -- a partial aggregate, so an order
    holding a third of all items collapses map-side -- and LEFT-joined 1:1
    to the scoped orders.  Per person, ``count(DISTINCT order_id)`` counts
    every scoped order (with or without items) and a conditional
    ``min(struct(purchase time, order_id, first item))`` over eligible
    item-bearing orders picks the first item exactly as
    ``first_item_product`` does.  Persons without one get NULL ``product_id``.
    """
    o = with_person(scoped_orders(mp, scope, cols=["order_id", "customer_id", "order_purchase_timestamp"]), mp)
    items = child_rows(mp, "order_items", scope)
    qty = [F.col("quantity")] if "quantity" in items.columns else []
    first_in_order = items.groupBy("order_id").agg(
        F.min(F.struct("order_item_id", "product_id", "seller_id", "price", *qty)).alias("fi"))
    it = o.join(first_in_order, "order_id", "left")
    eligible = (F.col("order_purchase_timestamp") < ts_lit(scope.eligible_before)) & F.col("fi").isNotNull()
    key = F.when(eligible, F.struct("order_purchase_timestamp", "order_id", "fi"))
    agg = it.groupBy("customer_unique_id").agg(F.count_distinct("order_id").alias("frequency"),
                                                F.min(key).alias("k"))
    return agg.select("customer_unique_id", F.col("frequency").cast("bigint").alias("frequency"),
                      F.col("k.fi.product_id").alias("product_id"))


def order_top_category(mp: Marketplace, scope: Scope, first: DataFrame | None = None) -> DataFrame:
    """FEA-1: category of the highest-priced translated item of each first order.

    Ties on price go to the lowest (order_item_id, product_id, seller_id,
    quantity).  Persons whose first order has no translated item drop out.
    Pass ``first`` (a cohort frame) to share its plan with the caller, so
    Spark reuses one exchange instead of aggregating the orders twice.
    """
    fo = (first if first is not None else cohort(mp, scope, payload=[])).select("customer_unique_id", "order_id")
    items = child_rows(mp, "order_items", scope)
    qty = [F.col("quantity")] if "quantity" in items.columns else []
    it = (fo.join(items.select("order_id", "order_item_id", "product_id", "seller_id", "price", *qty),
                  "order_id")
          .join(product_categories(mp), "product_id"))
    key = F.struct((-F.col("price")).alias("neg_price"), "order_item_id", "product_id", "seller_id",
                   *qty, "category", "price")
    return (it.groupBy("customer_unique_id").agg(F.min(key).alias("k"))
            .select("customer_unique_id", F.col("k.category").alias("category"),
                    F.col("k.price").cast("double").alias("top_item_price")))
