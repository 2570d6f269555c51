"""Append-only tables: idempotent appends, versions, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, existing: DataFrame, keys: list[list[str]], order: list[Column]) -> DataFrame:
    """Rows of ``batch`` that match nothing in ``existing`` by any of the keys, and of the rows of one key the first in ``order``.

    A key with a null matches nothing. The first rows are taken map-side, so a key of very many rows is no task's work
    alone, and rows without a key stay where they are.
    """
    out = batch
    for k in keys:
        out = out.join(existing.select(*k).distinct(), k, "left_anti")
    for k in keys:
        whole = F.lit(True)
        for c in k:
            whole &= F.col(c).isNotNull()
        row = F.struct(*[F.col(f"`{c}`") for c in out.columns])
        first = out.where(whole).groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(k)]).agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")
        out = first.unionByName(out.where(~whole))
    return out


def append_versioned(batch: DataFrame, existing: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows to append; a key that is there with other values raises an error."""
    old = existing.select(*key, F.struct(*values).alias("__old"))
    j = batch.join(old, key, "left")
    differ = F.col("__old").isNotNull() & ~F.col("__old").eqNullSafe(F.struct(*values))
    checked = j.withColumn("__ok", F.when(differ, F.raise_error(F.concat_ws("|", F.lit("changed values of an existing key"), *[F.col(k).cast("string") for k in key])).cast("boolean"))
                           .otherwise(F.col("__old").isNull()))
    return checked.where("__ok").drop("__ok", "__old")


def write_new(batch: DataFrame, path: str, key: list[str], order: list[Column], partition: list[str] | None = None) -> None:
    """Append to a Parquet table what it does not hold yet; running it twice adds nothing."""
    spark = batch.sparkSession
    try:
        existing = spark.read.parquet(path)
    except Exception as e:  # the first write creates the table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        existing = batch.limit(0)
    writer = new_rows(batch, existing, [key], order).write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def upsert_changes(current: DataFrame, incoming: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, action, before, after): insert, update or keep, field by field compared."""
    a = current.select(*key, F.struct(*fields).alias("before"))
    b = incoming.select(*key, F.struct(*fields).alias("after"))
    j = a.join(b, key, "full_outer")
    return j.withColumn("action", F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "absent")
                        .when(F.col("before").eqNullSafe(F.col("after")), "keep").otherwise("update"))


def active_rows(rows: DataFrame, corrections: DataFrame, key: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(rows that no valid correction supersedes, rejected corrections).

    A correction (old, new) must name two rows of one source; an old row is superseded once.
    """
    r = rows.select(F.col(key).alias("k"), F.col(source).alias("s"))
    j = (corrections.join(r.select(F.col("k").alias("old"), F.col("s").alias("so")), "old", "left")
         .join(r.select(F.col("k").alias("new"), F.col("s").alias("sn")), "new", "left"))
    n = F.row_number().over(Window.partitionBy("old").orderBy("new"))
    fine = F.col("so").isNotNull() & (F.col("so") == F.col("sn")) & (F.col("old") != F.col("new"))
    j = j.withColumn("__fine", F.coalesce(fine, F.lit(False))).withColumn("__n", n)
    valid = j.where("__fine and __n = 1")
    return rows.join(valid.select(F.col("old").alias(key)), key, "left_anti"), j.where("not (__fine and __n = 1)").select("old", "new")


def row_digest(columns: list[str]) -> Column:
    """Digest of a row over its sorted columns; null differs from empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(columns)]), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """(rows, digest), the same for any order of rows: the digests of rows are added in pieces of 32 bits, and the sums hashed.

    A row that repeats counts each time. Sums are made map-side, so no task sees more than sums.
    """
    d = df.select(row_digest(df.columns).alias("d"))
    piece = lambda i: F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")
    sums = d.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(piece(i)), F.lit(0)).alias(f"s{i}") for i in range(8)])
    return sums.select("rows", F.sha2(F.concat_ws("|", "rows", *[F.col(f"s{i}").cast("string") for i in range(8)]), 256).alias("digest"))


def copy_proof(source: DataFrame, target: DataFrame) -> DataFrame:
    """Whether two tables hold the same rows."""
    a, b = table_digest(source), table_digest(target)
    return a.crossJoin(b.select(F.col("rows").alias("target_rows"), F.col("digest").alias("target_digest"))).withColumn("equal", F.col("digest") == F.col("target_digest"))
