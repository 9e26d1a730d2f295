"""Session helpers for tests, bench and local runs.

On a cluster the caller owns the session; these helpers only fill in
settings that are unset, and never point anything at a machine-local
folder when the cluster already names one.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "repeatlens") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("REPEATLENS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoint files of ranked scans / materialised tables are removed
        # once their DataFrames are garbage-collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the session names.

    ``spark.checkpoint.dir`` (a shared, durable folder on a cluster) wins;
    only a ``local`` master with nothing configured -- tests -- gets a fresh
    scratch folder.  Any other master without the setting is an error: a
    machine-local folder would be invisible to the other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError(
                f"spark.checkpoint.dir is not set and the master is {sc.master}: name a folder "
                "that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="repeatlens-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Folders written by ``write_shared``, by application.
_WRITTEN: dict[str, list[str]] = {}
#: While a folder is written: shuffle files go with the write that made them,
#: not only when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the checkpoint folder and read it back.

    Cuts the lineage like a checkpoint, but compressed and columnar, so
    later readers still prune columns and push filters down.  The folder
    stays until ``release``: the result may be read at any time.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of ``write_shared`` that ``frames`` read: nothing may
    read them afterwards."""
    for df in frames:
        spark = df.sparkSession
        paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
        # by the folder's name: it is unique, and files are listed as URIs
        names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        for path in [p for p in paths if p.rsplit("/", 1)[-1] in names]:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
            # the list keeps its length: positions in it are marks
            paths[paths.index(path)] = path + ".discarded"


def written(spark: SparkSession) -> int:
    """How many folders ``write_shared`` has left so far; a mark for ``release``."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the folders that ``write_shared`` wrote after the mark ``since``
    (all by default) and return their number.

    Call it once the results that came from them are written elsewhere: frames
    that still read such a folder fail afterwards.
    """
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    gone = paths[since:]
    for path in gone:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    del paths[since:]
    return len(gone)


def materialize(df):
    """Write ``df`` once to the session's checkpoint folder and read it back.

    Used for per-person intermediates that a job reads several times (the
    RFM base, the feature table): without it every consumer re-runs the
    whole orders x items x customers chain.  A reliable checkpoint also
    cuts the lineage, so a lost executor does not replay that chain.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
