"""Canonical marketplace schemas (explicit, never inferred)."""

from pyspark.sql import types as T

_S, _TS, _I, _D = T.StringType(), T.TimestampNTZType(), T.IntegerType(), T.DecimalType(12, 2)

ORDERS = T.StructType([
    T.StructField("order_id", _S, False),
    T.StructField("customer_id", _S, False),
    T.StructField("order_status", _S, False),
    T.StructField("order_purchase_timestamp", _TS, False),
    T.StructField("order_approved_at", _TS, True),
    T.StructField("order_delivered_carrier_date", _TS, True),
    T.StructField("order_delivered_customer_date", _TS, True),
    T.StructField("order_estimated_delivery_date", _TS, True),
])

ORDER_ITEMS = T.StructType([
    T.StructField("order_id", _S, False),
    T.StructField("order_item_id", _I, False),
    T.StructField("product_id", _S, False),
    T.StructField("seller_id", _S, False),
    T.StructField("shipping_limit_date", _TS, True),
    T.StructField("price", _D, False),
    T.StructField("freight_value", _D, False),
])

CUSTOMERS = T.StructType([
    T.StructField("customer_id", _S, False),
    T.StructField("customer_unique_id", _S, False),
    T.StructField("customer_zip_code_prefix", _S, True),
    T.StructField("customer_city", _S, True),
    T.StructField("customer_state", _S, True),
])

PRODUCTS = T.StructType([
    T.StructField("product_id", _S, False),
    T.StructField("product_category_name", _S, True),
    T.StructField("product_name_lenght", _I, True),
    T.StructField("product_description_lenght", _I, True),
    T.StructField("product_photos_qty", _I, True),
    T.StructField("product_weight_g", _I, True),
    T.StructField("product_length_cm", _I, True),
    T.StructField("product_height_cm", _I, True),
    T.StructField("product_width_cm", _I, True),
])

CATEGORY_TRANSLATION = T.StructType([
    T.StructField("product_category_name", _S, False),
    T.StructField("product_category_name_english", _S, False),
])

ORDER_PAYMENTS = T.StructType([
    T.StructField("order_id", _S, False),
    T.StructField("payment_sequential", _I, False),
    T.StructField("payment_type", _S, False),
    T.StructField("payment_installments", _I, False),
    T.StructField("payment_value", _D, False),
])

ORDER_REVIEWS = T.StructType([
    T.StructField("review_id", _S, False),
    T.StructField("order_id", _S, False),
    T.StructField("review_score", _I, True),
    T.StructField("review_comment_title", _S, True),
    T.StructField("review_comment_message", _S, True),
    T.StructField("review_creation_date", _TS, True),
    T.StructField("review_answer_timestamp", _TS, True),
])

SELLERS = T.StructType([
    T.StructField("seller_id", _S, False),
    T.StructField("seller_zip_code_prefix", _S, True),
    T.StructField("seller_city", _S, True),
    T.StructField("seller_state", _S, True),
])

GEOLOCATION = T.StructType([
    T.StructField("geolocation_zip_code_prefix", _S, True),
    T.StructField("geolocation_lat", T.DoubleType(), True),
    T.StructField("geolocation_lng", T.DoubleType(), True),
    T.StructField("geolocation_city", _S, True),
    T.StructField("geolocation_state", _S, True),
])

# default raw file name per table; pass ``files={table: name}`` to the
# readers for files named differently
CSV_FILES = {name: f"{name}.csv" for name in (
    "customers", "orders", "order_items", "order_payments", "order_reviews", "products",
    "sellers", "geolocation", "category_translation")}

SCHEMAS = {
    "customers": CUSTOMERS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "order_payments": ORDER_PAYMENTS,
    "order_reviews": ORDER_REVIEWS,
    "products": PRODUCTS,
    "sellers": SELLERS,
    "geolocation": GEOLOCATION,
    "category_translation": CATEGORY_TRANSLATION,
}

# columns every job needs, per table (the rest are carried but unused)
REQUIRED = {
    "orders": ["order_id", "customer_id", "order_status", "order_purchase_timestamp",
               "order_delivered_customer_date", "order_estimated_delivery_date"],
    "order_items": ["order_id", "order_item_id", "product_id", "seller_id", "price",
                    "freight_value"],
    "customers": ["customer_id", "customer_unique_id", "customer_state"],
    "products": ["product_id", "product_category_name"],
    "category_translation": ["product_category_name", "product_category_name_english"],
    "order_payments": ["order_id", "payment_installments", "payment_value", "payment_type"],
    "order_reviews": ["order_id", "review_score"],
}
