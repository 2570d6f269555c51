"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: str | None = None


def root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Without the setting a session on one machine gets a temporary folder; on a cluster, where no
    local folder is shared, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = "file://" + tempfile.mkdtemp(prefix="asofkit-")
    return _LOCAL


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new table or folder of files."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the bytes of an Arrow batch, so that long texts do not fill a worker; a smaller set value stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")  # the default has a unit
    if not now.isdigit() or int(now) > size:
        spark.conf.set(key, str(size))


def save(df: DataFrame, name: str) -> DataFrame:
    """Written as a table and read back, so that lineage ends there."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete saved tables that nothing reads any more, and let Spark's cleaner remove the shuffle files of finished plans."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.5)  # executors delete the files in the background


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root(spark))
    return df.checkpoint()
