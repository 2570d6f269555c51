"""Positions and running sums over a total order without a single-task window.

Rows are dealt by range of the sort columns, numbered inside their partition, and shifted by the
totals of the partitions before. Only one total per partition meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut


def running_total(df: DataFrame, order: list[Column], amount: Column, name: str,
                  partitions: int | None = None) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over all rows before this one in ``order``.

    ``order`` must be a total order for the result to be unique; rows that tie in all its columns
    get some order among themselves. Null amounts count as 0. An empty table stays empty.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select("*", *[c.alias(f"__o{i}") for i, c in enumerate(order)],
                      F.coalesce(amount, F.lit(0)).cast("long").alias("__a"))
    keys = [F.col(f"__o{i}") for i in range(len(order))]
    dealt = cut(keyed.repartitionByRange(n, *keys).withColumn("__p", F.spark_partition_id()))
    totals = dealt.groupBy("__p").agg(F.sum("__a").alias("__t"))
    # One row per partition: its number bounds this window and the broadcast below.
    before = totals.select(
        "__p", F.coalesce(F.sum("__t").over(
            Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    inside = Window.partitionBy("__p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("__s", F.coalesce(F.sum("__a").over(inside), F.lit(0)))
            .join(F.broadcast(before), "__p")
            .withColumn(name, F.col("__s") + F.col("__b"))
            .drop("__p", "__s", "__b", "__a", *[f"__o{i}" for i in range(len(order))]))


def global_rank(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name``: the 0-based position of the row in ``order``."""
    return running_total(df, order, F.lit(1), name, partitions)
