"""Dimensions with keys of their own: seeds, and authors with the accounts that point to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .intake import blank, parse_accounts
from .store import new_rows

MEMBERS = "entity string, id string, name string, parent string, source string, external_id string, verified boolean, followers bigint, meta string"


def stable_id(*natural: Column) -> Column:
    """128 bits of a digest of the natural key: the same key in every run and on every executor."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in natural]), 256), 1, 32)


def seed(definitions: DataFrame, existing: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, with ``id``; report (created, existing)) of definitions; one that is there keeps its values.

    A definition without its whole key is neither. Of definitions of one key the one with the least values counts.
    """
    whole = F.lit(True)
    for k in key:
        whole &= ~blank(F.col(k).cast("string"))
    known = definitions.where(whole)
    rest = [F.col(c) for c in definitions.columns if c not in key] or [F.lit(0)]
    new = new_rows(known, existing.select(*key), [key], rest).withColumn("id", stable_id(*map(F.col, key)))
    report = (known.select(*key).distinct().join(existing.select(*key).distinct().withColumn("__there", F.lit(True)), key, "left")
              .agg(F.count_if(F.col("__there").isNull()).alias("created"), F.count("__there").alias("existing")))
    return new, report


def members(spark: SparkSession, path: str) -> DataFrame:
    """The table of authors and accounts; empty before the first load."""
    try:
        return spark.read.schema(MEMBERS).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MEMBERS)


def author_load(rows: DataFrame, sources: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members to insert, problems) of text rows as ``parse_accounts`` takes them.

    A row is an author and an account. If its source is not in ``sources`` (name), or its account belongs to another
    author, in the table or by an earlier row, neither is inserted and the row is a problem. Accounts point to authors by id.
    """
    fine, problems = parse_accounts(rows)
    author_id = stable_id(F.lit("author"), F.lower("author_name"))
    unit = fine.select("*", author_id.alias("author_id"), stable_id(F.lit("account"), F.col("source"), F.col("external_account_id")).alias("account_id"))
    unit = unit.join(sources.select(F.col("name").alias("source")).distinct().withColumn("__source", F.lit(True)), "source", "left")
    there = existing.where("entity = 'account'").select(F.col("id").alias("account_id"), F.col("parent").alias("__there"))
    first = unit.where("__source").groupBy("account_id").agg(F.min_by("author_id", "row").alias("__first"))
    unit = unit.join(there, "account_id", "left").join(first, "account_id", "left")
    owner = F.coalesce("__there", "__first")
    orphan = F.when(F.col("__source").isNull(), "unknown_source").when(owner != F.col("author_id"), "account_of_another_author")
    unit = unit.withColumn("problem", orphan)
    good = unit.where("problem is null")
    null = lambda kind: F.lit(None).cast(kind)
    authors = good.groupBy("author_id").agg(F.min_by("author_name", "row").alias("name")).select(
        F.lit("author").alias("entity"), F.col("author_id").alias("id"), "name", null("string").alias("parent"), null("string").alias("source"), null("string").alias("external_id"),
        null("boolean").alias("verified"), null("bigint").alias("followers"), null("string").alias("meta"))
    chosen = good.groupBy("account_id").agg(F.min_by(F.struct("author_id", "source", "external_account_id", "verified", "followers", "meta"), "row").alias("a"))
    accounts = chosen.select(F.lit("account").alias("entity"), F.col("account_id").alias("id"), null("string").alias("name"), F.col("a.author_id").alias("parent"), "a.source",
                             F.col("a.external_account_id").alias("external_id"), "a.verified", "a.followers", "a.meta")
    new = authors.unionByName(accounts).join(existing.select("entity", "id"), ["entity", "id"], "left_anti").select(*[x.split(" ")[0] for x in MEMBERS.split(", ")])
    return new, problems.unionByName(unit.where("problem is not null").select("row", "problem"))


def load_authors(rows: DataFrame, sources: DataFrame, path: str) -> DataFrame:
    """Appends what is new to the table of members in one commit, authors and accounts together; gives the problems.

    Loading the same rows again adds nothing. A lost job leaves the table as it was.
    """
    new, problems = author_load(rows, sources, members(rows.sparkSession, path))
    new.write.mode("append").parquet(path)
    return problems
