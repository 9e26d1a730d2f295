"""ML-12, ML-14, ML-15: a fitted model is stored once and read by every job.

A stored fit is named by a digest of the rows it learned from and of its
parameters, so a job finds the fit of equal input whoever made it, and new
data or settings make a new one.  It holds the pipeline and its scored
hold-out rows.  A fit counts as stored once its last file, the marker, is
there; one that was cut short is made anew under the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatlens.session import ensure_checkpoint_dir


def frame_digest(df: DataFrame, parameters: object) -> str:
    """Hex name of ``df``'s rows, in any order and partitioning, and of
    ``parameters`` (by their repr): three aggregates over one pass."""
    columns = sorted(df.columns)
    h = [F.xxhash64(*columns, F.lit(seed)).cast("decimal(38,0)") for seed in (1, 2)]
    row = df.agg(F.count(F.lit(1)), *[F.sum(x) for x in h]).first()
    said = repr((columns, tuple(map(str, row)), parameters))
    return hashlib.sha256(said.encode()).hexdigest()[:32]


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def stored_fit(df: DataFrame, parameters: object, fit: Callable[[], tuple[PipelineModel, DataFrame]],
               folder: str | None = None) -> tuple[PipelineModel, DataFrame]:
    """The pipeline and scored rows that ``fit`` returns, from the store if
    they are there.  ``folder``: by default below the session's checkpoint
    folder; name another shared one to keep fits beyond the session."""
    spark = df.sparkSession
    root = folder or f"{ensure_checkpoint_dir(spark)}/models"
    path = f"{root.rstrip('/')}/{frame_digest(df, parameters)}"
    if not _exists(spark, f"{path}/marker/_SUCCESS"):
        model, scored = fit()
        model.write().overwrite().save(f"{path}/model")
        scored.write.mode("overwrite").parquet(f"{path}/scored")
        spark.range(1).write.mode("overwrite").parquet(f"{path}/marker")
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/scored")
