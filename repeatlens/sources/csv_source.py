"""SRC-1..3: typed CSV ingest of the raw marketplace files.

Schemas are explicit (no inference) and rows that do not parse fail the
read (FAILFAST) instead of silently turning into NULLs.  Ingest writes
Parquet once; every analysis then reads columnar data with pushdown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatlens.session import write_shared
from repeatlens.sources.schemas import CSV_FILES, SCHEMAS
from repeatlens.sources.tables import Marketplace

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_csv_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One raw file (or folder of files), read by its header.

    Columns may stand in any order; others than the schema's are ignored, and
    a missing one raises.  With several files the header of each must be the
    same.
    """
    def reader():
        return (spark.read.option("header", True).option("escape", '"')
                .option("multiLine", name == "order_reviews"))

    known = {f.name: f for f in SCHEMAS[name].fields}
    header = reader().option("inferSchema", False).csv(path).columns  # reads the first line
    missing = [c for c in known if c not in header]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header")
    schema = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
    return (reader().schema(schema).option("enforceSchema", False).option("mode", "FAILFAST")
            .option("timestampNTZFormat", TIMESTAMP_FORMAT).csv(path).select(*known))


def read_marketplace_csv(spark: SparkSession, folder: str,
                         files: dict[str, str] | None = None) -> Marketplace:
    """Read the seven analysed tables from a folder of raw CSV files."""
    files = files or CSV_FILES
    t = {n: read_csv_table(spark, f"{folder.rstrip('/')}/{files[n]}", n)
         for n in ("orders", "order_items", "customers", "products", "category_translation",
                   "order_payments", "order_reviews")}
    return Marketplace(**t).validate()


#: Tables whose rows belong to an order and are stored by its month.
CHILDREN = ("order_items", "order_payments", "order_reviews")


def month_of(orders: DataFrame) -> DataFrame:
    """(order_id, purchase_month), written once: every child table joins it,
    and the orders are read for it a single time."""
    month = F.date_format("order_purchase_timestamp", "yyyy-MM").alias("purchase_month")
    return write_shared(orders.select("order_id", month).distinct(), "months")


def _by_month(name: str, df: DataFrame, months: DataFrame) -> DataFrame:
    """``df`` with the purchase month of its order, gathered by month.

    ``REBALANCE`` gives a month as many writers as its size needs and no
    more, so there are not tasks x months small files.
    """
    month = F.date_format("order_purchase_timestamp", "yyyy-MM").alias("purchase_month")
    if name == "orders":
        df = df.withColumn("purchase_month", month)
    else:
        df = df.join(months, "order_id", "left")
    return df.hint("rebalance", "purchase_month")


def _check_one_month(months: DataFrame) -> None:
    """An order id in two months would store its children twice."""
    twice = months.groupBy("order_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"order {twice[0].order_id} was purchased in several months; "
                         "store the tables without month partitions")


def ingest_to_parquet(spark: SparkSession, folder: str, out_dir: str,
                      files: dict[str, str] | None = None, by_month: bool = True) -> DataFrame:
    """Replace-load every raw CSV as Parquet and audit row counts.

    The count is taken with ``DataFrame.observe`` during the write itself.
    Orders and the rows that belong to them are partitioned by purchase month
    (see ``write_canonical``).  Returns a (table, rows) frame.
    """
    from pyspark.sql.observation import Observation

    files = files or CSV_FILES
    tables = {n: read_csv_table(spark, f"{folder.rstrip('/')}/{f}", n) for n, f in files.items()}
    months = month_of(tables["orders"]) if by_month else None
    if by_month:
        _check_one_month(months)
    audit = []
    for name, df in tables.items():
        o = Observation(f"ingest_{name}")
        df = df.observe(o, F.count(F.lit(1)).alias("rows"))
        _write(name, df, months, out_dir)
        audit.append((name, int(o.get["rows"])))
    return spark.createDataFrame(audit, "table string, rows bigint")


def _write(name: str, df: DataFrame, months: DataFrame | None, out_dir: str) -> None:
    path = f"{out_dir.rstrip('/')}/{name}"
    if months is not None and name in ("orders", *CHILDREN):
        _by_month(name, df, months).write.mode("overwrite").partitionBy("purchase_month").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_canonical(mp: Marketplace, out_dir: str, by_month: bool = True) -> None:
    """Write the seven canonical tables as Parquet.

    With ``by_month`` orders, items, payments and reviews get the order's
    ``purchase_month`` ('yyyy-MM') as partition column (rows without an order
    a null one); ``plans.base`` then adds the scope's month bounds, so a
    window of one year out of many prunes whole directories of all four
    tables at planning time (PartitionFilters)."""
    months = month_of(mp.orders) if by_month else None
    if by_month:
        _check_one_month(months)
    for name, df in mp.tables().items():
        _write(name, df, months, out_dir)


def read_marketplace_parquet(spark: SparkSession, folder: str) -> Marketplace:
    t = {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}")
         for n in ("orders", "order_items", "customers", "products", "category_translation",
                   "order_payments", "order_reviews")}
    return Marketplace(**t).validate()
