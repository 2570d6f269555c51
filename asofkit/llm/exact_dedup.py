"""Exact deduplication with stateful streaming.

The stream's rows are (digest, stable identifier, content locator). Keyed state on disk (RocksDB),
without watermark and so without expiry, holds for every digest the identifier and locator of the
row to keep and the number of rows seen. Rows are combined by digest before the shuffle, so a text
that a third of all rows share sends one row per task to its state. Texts of digests that were hit
more than once are then compared in full.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .skew import join_counted

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # One bounded memory pool for all state partitions of an executor.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    # Small tables in memory: every state partition of an executor has one.
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    # Else each state partition reserves 4 MB of disk for its manifest before it holds a row.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalise(text: Column) -> Column:
    """A-Z to lower case, nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def dedup_state(stream: DataFrame) -> DataFrame:
    """Streaming (digest, id, locator) rows -> per digest the row to keep and the rows seen."""
    return stream.groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("keep"),
                                        F.count(F.lit(1)).alias("group_size"))


def _run_stream(scratch: Scratch, rows: DataFrame, batches: int) -> DataFrame:
    """Feed the table of digests through the stateful query; the last state of every digest."""
    spark = rows.sparkSession
    saved = scratch.save(rows, "rows")
    files = max(1, -(-len(saved.inputFiles()) // batches))
    was = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(scratch.path("rows"))

        def store(changed: DataFrame, batch: int) -> None:
            # The path names the batch: a batch that runs again after a failure writes the same place.
            changed.write.mode("overwrite").parquet(scratch.path(f"state/batch={batch}"))

        query = (dedup_state(stream).writeStream.outputMode("update").foreachBatch(store)
                 .option("checkpointLocation", scratch.path("query")).trigger(availableNow=True).start())
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    schema = "digest binary, keep struct<id: bigint, locator: bigint>, group_size bigint"
    if not query.lastProgress or query.lastProgress["batchId"] < 0:
        return spark.createDataFrame([], schema)
    # State only grows, so the newest value of a digest is its largest.
    return (spark.read.schema(schema).parquet(scratch.path("state"))
            .groupBy("digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2,
                digest=sha256_digest) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, digest.

    Texts are equal if identical after lower-casing A-Z; null equals empty. Of equal texts the row
    with the largest identifier stays (a null identifier loses to any other); of rows that repeat
    both text and identifier one stays. An empty table gives no rows. Other columns, whatever
    their names, are not read. ``digest`` may be any function of the normalised text: texts that
    share a digest but differ are told apart by their full bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    text = normalise(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), digest(text).alias("digest"),
                       F.monotonically_increasing_id().alias("locator"))
    state = scratch.save(_run_stream(scratch, rows, batches), "final")
    rows = scratch.load(rows.schema, "rows")
    scratch.drop("state", "query")

    # Full bytes on hits: all texts of a digest are equal iff the smallest is the largest.
    hits = state.where("group_size > 1").select("digest", "group_size")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t")).withColumn("digest", digest(F.col("t")))
    total = rows.count()
    # Rows of a digest with many copies are compared where they are; only the least and greatest text of each task move.
    differ = scratch.save(join_counted(texts, hits, ["digest"], "group_size", total).groupBy("digest")
                          .agg((F.min("t") != F.max("t")).alias("differ")).where("differ").select("digest"), "differ")
    found = join_counted(rows, state, ["digest"], "group_size", total).select(
        "id", F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("locator") == F.col("keep.locator")).alias("kept"), "digest")
    if differ.isEmpty():
        return found.withColumnRenamed("id", id_col)
    # Different texts under one digest: group these few by their bytes instead.
    apart = texts.join(differ, "digest", "left_semi").withColumn("locator", F.monotonically_increasing_id())
    apart = scratch.save(apart, "apart")
    best = apart.groupBy("digest", "t").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    told = apart.join(best, ["digest", "t"]).select(
        "id", F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("locator") == F.col("keep.locator")).alias("kept"), "digest")
    return found.join(differ, "digest", "left_anti").unionByName(told).withColumnRenamed("id", id_col)
