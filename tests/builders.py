"""Tiny hand-written canonical tables for edge-case tests."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from repeatlens.scope import Scope
from repeatlens.sources.tables import Marketplace

ORDERS = ("order_id string, customer_id string, order_status string, "
          "order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz, "
          "order_estimated_delivery_date timestamp_ntz")
ITEMS = ("order_id string, order_item_id int, product_id string, seller_id string, "
         "price decimal(12,2), freight_value decimal(12,2)")
CUSTOMERS = "customer_id string, customer_unique_id string, customer_state string"
PRODUCTS = "product_id string, product_category_name string"
CT = "product_category_name string, product_category_name_english string"
PAYMENTS = "order_id string, payment_type string, payment_installments int, payment_value decimal(12,2)"
REVIEWS = "order_id string, review_score int"

SCOPE = Scope(window_start="2017-01-01 00:00:00", window_end="2018-09-01 00:00:00",
              eligible_before="2018-03-01 00:00:00", snapshot="2018-09-01 00:00:00",
              min_category_buyers=1, min_state_customers=1)


def ts(s: str | None) -> datetime | None:
    if s is None:
        return None
    return datetime.fromisoformat(s)


def d(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def order(oid, cid, purchase, status="delivered", delivered="auto", estimated="auto"):
    p = ts(purchase)
    from datetime import timedelta

    dl = p + timedelta(days=10) if delivered == "auto" else ts(delivered)
    es = p + timedelta(days=20) if estimated == "auto" else ts(estimated)
    return (oid, cid, status, p, dl, es)


def market(spark, orders, items, customers, products=(), ct=(), payments=(), reviews=()) -> Marketplace:
    def df(rows, schema):
        return spark.createDataFrame(list(rows), schema)

    items = [(o, i, p, s, d(pr), d(fr)) for (o, i, p, s, pr, fr) in items]
    payments = [(o, t, n, d(v)) for (o, t, n, v) in payments]
    return Marketplace(df(orders, ORDERS), df(items, ITEMS), df(customers, CUSTOMERS),
                       df(products, PRODUCTS), df(ct, CT), df(payments, PAYMENTS),
                       df(reviews, REVIEWS)).validate()
