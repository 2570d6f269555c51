"""Shared-folder tables that cut lineage.

Every intermediate result that is read more than once is written below the folder that the
session names in ``spark.checkpoint.dir``, which all executors and the driver share. Where the
setting is absent, a session on one machine uses a temporary folder; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from .kept import free


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only if unset, and on one machine, a temporary one of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = "file://" + tempfile.mkdtemp(prefix="asofkit-checkpoint-")
    return _LOCAL


_LOCAL: str | None = None


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def cut(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint: lineage ends at files in the shared folder.

    Spark's context cleaner deletes the files once the result is garbage, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the bytes of an Arrow batch, so that long texts do not fill a worker; a set value stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")  # the default has a unit
    if not now.isdigit() or int(now) > size:
        spark.conf.set(key, str(size))


class Scratch:
    """Parquet tables of one operator call, for intermediates too large for ``cut``."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/asofkit-{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str, **options) -> DataFrame:
        df.write.options(**options).parquet(self.path(table))
        return self.load(df.schema, table)

    def load(self, schema, table: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Delete the named tables, or everything when none is named."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for target in [self.path(t) for t in tables] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(target)
            path.getFileSystem(conf).delete(path, True)


def trim(spark: SparkSession) -> None:
    """Give what the driver's allocators hold free back to the system, in Python and in the JVM.

    Many plans leave the C library's arenas with some hundred MB of free memory, which no garbage
    collection returns. A JVM without that command keeps it.
    """
    free()
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # The server's own class is not exported, its interface is.
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = new(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner remove shuffle files of plans that are no longer referenced; trim the driver."""
    free()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)  # executors delete the files in the background
    trim(spark)
