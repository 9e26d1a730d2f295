"""Co-located storage: canonical tables bucketed on their join keys.

Every analysis joins ``orders`` with ``order_items``, ``order_payments``
and ``order_reviews`` on ``order_id`` and rolls items up per order.  Written
once with the same ``bucketBy(n, "order_id")`` (and sorted by it), those
joins and per-order aggregates read matching buckets side by side and need
no shuffle; at scale that removes the exchange of the largest table
(``order_items``).  ``customers`` and ``products`` are bucketed on their own
keys for the same reason.  Bucket count: pick it so one bucket is a few
hundred MB of the largest table.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from repeatlens.sources.tables import Marketplace

BUCKET_KEYS = {
    "orders": "order_id",
    "order_items": "order_id",
    "order_payments": "order_id",
    "order_reviews": "order_id",
    "customers": "customer_id",
    "products": "product_id",
}


def write_colocated(spark: SparkSession, mp: Marketplace, database: str, location: str,
                    buckets: int) -> None:
    """Write the canonical tables as bucketed external tables under ``location``."""
    # the database itself lives under ``location`` too (shared storage on a cluster)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location.rstrip('/')}/_database'")
    for name, df in mp.tables().items():
        w = df.write.mode("overwrite").format("parquet").option("path", f"{location.rstrip('/')}/{name}")
        key = BUCKET_KEYS.get(name)
        if key:
            w = w.bucketBy(buckets, key).sortBy(key)
        w.saveAsTable(f"{database}.{name}")


def read_colocated(spark: SparkSession, database: str) -> Marketplace:
    return Marketplace(**{n: spark.table(f"{database}.{n}") for n in
                          ("orders", "order_items", "customers", "products", "category_translation",
                           "order_payments", "order_reviews")}).validate()
