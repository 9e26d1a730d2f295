"""SNK-1..3: write results and cleaned tables for downstream BI tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repeatlens.sources.tables import Marketplace


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Write one result; CSV gets a header row (a folder of part files)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    else:
        w.format(fmt).save(path)


def export_tables(spark: SparkSession, mp: Marketplace, out_dir: str, fmt: str = "parquet",
                  prefix: str = "clean_") -> DataFrame:
    """Bulk-export the cleaned tables, then re-read each and check its count.

    Returns (table, written_rows, read_back_rows, ok); the written count
    comes from an observation on the write, the read-back from the files.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.observation import Observation

    rows = []
    for name, df in mp.tables().items():
        path = f"{out_dir.rstrip('/')}/{prefix}{name}"
        o = Observation(f"export_{name}")
        write_table(df.observe(o, F.count(F.lit(1)).alias("n")), path, fmt)
        written = int(o.get["n"])
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        back = reader.format(fmt).load(path).count()
        rows.append((name, written, back, written == back))
    return spark.createDataFrame(rows, "table string, written_rows bigint, read_back_rows bigint, ok boolean")
