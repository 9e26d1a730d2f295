"""SRC-2, SNK-3: replace-loads that touch only the months that changed.

The stored tables are partitioned by ``purchase_month`` (``csv_source``).  A
reload writes the given months with dynamic partition overwrite, so the
directories of all other months keep their files; a month that has no rows
any more loses its directory.  The small tables have no month and are
replaced whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatlens.sources.csv_source import CHILDREN, _by_month, _check_one_month, month_of
from repeatlens.sources.tables import Marketplace

MONTH = "purchase_month"


def overwrite_months(df: DataFrame, path: str, months: Sequence[str]) -> None:
    """Replace the directories of ``months`` below ``path`` by ``df``'s rows,
    which must carry ``purchase_month`` and belong to those months."""
    spark = df.sparkSession
    held = F.col(MONTH).isin(*months)
    df = df.withColumn(MONTH, F.when(held, F.col(MONTH)).otherwise(
        F.raise_error(F.lit("a row belongs to a month that is not reloaded")).cast("string")))
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    there = {r[0] for r in df.select(MONTH).distinct().collect()}  # at most the months given
    for month in sorted(set(months) - there):
        _remove(spark, f"{path.rstrip('/')}/{MONTH}={month}")


def _remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jpath):
        fs.delete(jpath, True)


def reload_months(mp: Marketplace, folder: str, months: Sequence[str]) -> None:
    """Bring the tables stored in ``folder`` up to ``mp`` for ``months``.

    ``mp`` needs hold these months only.  An order id that the store keeps in
    another month is refused: its rows would then be there twice (name both
    months).  Rows without an order have no month and wait for a full load.
    """
    if not months:
        return
    spark = mp.orders.sparkSession
    root = folder.rstrip("/")
    month = F.date_format("order_purchase_timestamp", "yyyy-MM")
    orders = mp.orders.filter(month.isin(*months))
    placed = month_of(orders)
    _check_one_month(placed)
    stored = spark.read.parquet(f"{root}/orders").filter(~F.col(MONTH).isin(*months))
    moved = orders.join(stored.select("order_id"), "order_id", "left_semi").limit(1).collect()
    if moved:
        raise ValueError(f"order {moved[0].order_id} is stored in a month that is not reloaded")
    for name, df in mp.tables().items():
        if name not in ("orders", *CHILDREN):
            df.write.mode("overwrite").parquet(f"{root}/{name}")
            continue
        rows = orders if name == "orders" else df.join(orders.select("order_id"), "order_id", "left_semi")
        overwrite_months(_by_month(name, rows, placed), f"{root}/{name}", months)
