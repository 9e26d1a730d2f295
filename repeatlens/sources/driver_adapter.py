"""Map the driver's TPC-H-style tables onto the canonical marketplace tables.

The mapping (see FIXTURES.md) keeps every property the jobs must respect:
per-order ``customer_id`` vs per-person ``customer_unique_id``, orders
without items, NULL delivery dates, NULL / untranslated categories, and
0..n payments and reviews per order.  All frames are lazy; Spark prunes
whatever a job does not read (e.g. the delivery-date aggregate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatlens.sources.tables import Marketplace

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# fixed values: driver order status -> marketplace status
STATUS_MAP = {"F": "delivered", "O": "shipped", "P": "processing"}
# fixed values: driver part type -> translated category (SMALL has no
# translation, STANDARD is a product without category)
CATEGORY_TRANSLATION = [
    ("ECONOMY", "economy_en"),
    ("LARGE", "large_en"),
    ("MEDIUM", "medium_en"),
    ("PROMO", "promo_en"),
]
UNCATEGORISED_TYPE = "STANDARD"
ESTIMATED_DELIVERY_DAYS = 30


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def from_driver_tables(spark: SparkSession, sf_dir: str) -> Marketplace:
    t = {n: read_driver_table(spark, sf_dir, n) for n in ("nation", "customer", "part", "orders", "lineitem")}
    orders_raw, line = t["orders"], t["lineitem"]

    # a CASE over the raw status: filters on it run above the scan, they are
    # not pushed into Parquet
    status = F.lit(None).cast("string")
    for k, v in reversed(list(STATUS_MAP.items())):
        status = F.when(F.col("o_orderstatus") == k, F.lit(v)).otherwise(status)
    shipped = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").alias("order_delivered_customer_date"))
    orders = (
        orders_raw.join(shipped, "o_orderkey", "left")
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderkey").alias("customer_id"),
            status.alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            F.col("order_delivered_customer_date"),
            F.timestamp_add("DAY", F.lit(ESTIMATED_DELIVERY_DAYS), F.col("o_orderdate"))
            .alias("order_estimated_delivery_date"),
        )
    )

    customers = (
        orders_raw.select("o_orderkey", "o_custkey")
        .join(t["customer"].select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        .join(t["nation"].select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
        .select(
            F.col("o_orderkey").alias("customer_id"),
            F.col("o_custkey").alias("customer_unique_id"),
            F.col("n_name").alias("customer_state"),
        )
    )

    price = F.col("l_extendedprice").cast("decimal(12,2)")
    order_items = line.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        price.alias("price"),
        (price * F.col("l_tax").cast("decimal(4,2)")).alias("freight_value"),
    )

    products = t["part"].select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_type") != UNCATEGORISED_TYPE, F.col("p_type")).alias("product_category_name"),
    )

    category_translation = spark.createDataFrame(
        CATEGORY_TRANSLATION, "product_category_name string, product_category_name_english string")

    order_payments = line.filter(F.col("l_returnflag") != "A").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.col("l_linestatus").alias("payment_type"),
        F.col("l_quantity").cast("int").alias("payment_installments"),
        price.alias("payment_value"),
    )

    order_reviews = line.filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("order_id"),
        (F.lit(1) + F.pmod(F.col("l_partkey"), F.lit(5))).cast("int").alias("review_score"),
    )

    return Marketplace(orders, order_items, customers, products, category_translation,
                       order_payments, order_reviews).validate()


def oracle_prefix() -> str:
    """The same mapping as SQL CTEs (names prefixed ``m_``) for DuckDB."""
    status_case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_MAP.items())
    ct_values = ", ".join(f"('{a}', '{b}')" for a, b in CATEGORY_TRANSLATION)
    return f"""
m_shipped AS (
  SELECT l_orderkey, max(l_shipdate) AS delivered FROM lineitem GROUP BY l_orderkey),
m_orders AS (
  SELECT o.o_orderkey AS order_id, o.o_orderkey AS customer_id,
         CASE o.o_orderstatus {status_case} END AS order_status,
         o.o_orderdate AS order_purchase_timestamp,
         s.delivered AS order_delivered_customer_date,
         o.o_orderdate + INTERVAL '{ESTIMATED_DELIVERY_DAYS}' DAY AS order_estimated_delivery_date
  FROM orders o LEFT JOIN m_shipped s ON s.l_orderkey = o.o_orderkey),
m_customers AS (
  SELECT o.o_orderkey AS customer_id, o.o_custkey AS customer_unique_id, n.n_name AS customer_state
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey),
m_order_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, CAST(l_quantity AS INTEGER) AS quantity,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
         CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS freight_value
  FROM lineitem),
m_products AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_type <> '{UNCATEGORISED_TYPE}' THEN p_type END AS product_category_name
  FROM part),
m_category_translation AS (
  SELECT * FROM (VALUES {ct_values}) t(product_category_name, product_category_name_english)),
m_order_payments AS (
  SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential, l_linestatus AS payment_type,
         CAST(l_quantity AS INTEGER) AS payment_installments,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS payment_value
  FROM lineitem WHERE l_returnflag <> 'A'),
m_order_reviews AS (
  SELECT l_orderkey AS order_id, CAST(1 + l_partkey % 5 AS INTEGER) AS review_score
  FROM lineitem WHERE l_returnflag = 'R')"""
