"""Domain tables as projections of the star-schema tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import folder as folder  # queries name it through this module


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(c) -> F.Column:
    """Text form of a time, the same in every session time zone."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _hourly(e: DataFrame) -> DataFrame:
    at = F.struct("ts", "event_id")
    return (e.groupBy("instrument", "open_time").agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
                                                    F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume"))
            .withColumn("close_time", F.col("open_time") + F.expr("interval 1 hour")))


def bars_1h(spark: SparkSession, d: str) -> DataFrame:
    return _hourly(table(spark, d, "events").select(F.col("event_type").alias("instrument"), F.date_trunc("hour", "ts").alias("open_time"), "ts", "event_id", "value"))


def bars_all(spark: SparkSession, d: str) -> DataFrame:
    """The bars of every type, and those of all events together, which have no gaps."""
    e = table(spark, d, "events").select(F.explode(F.array("event_type", F.lit("ALL"))).alias("instrument"), F.date_trunc("hour", "ts").alias("open_time"), "ts", "event_id", "value")
    return _hourly(e)


BARS = """bars AS (SELECT event_type AS instrument, date_trunc('hour', ts) AS open_time, date_trunc('hour', ts) + INTERVAL 1 HOUR AS close_time,
  arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS volume
  FROM events GROUP BY ALL)"""
BARS_ALL = BARS.replace("FROM events", "FROM (SELECT * FROM events UNION ALL SELECT * REPLACE ('ALL' AS event_type) FROM events)")



def slots(spark: SparkSession, d: str) -> DataFrame:
    """Hourly slots; every third one of two days a week has no price."""
    b = bars_1h(spark, d)
    gone = (F.weekday("open_time") >= 5) & (F.hour("open_time") % 3 == 0) | (F.dayofmonth("open_time") == 17)
    return b.select("instrument", "open_time", F.when(~gone, F.col("open")).alias("open"))


SLOTS = BARS + """, slots AS (SELECT instrument, open_time, CASE WHEN NOT ((isodow(open_time) >= 6 AND hour(open_time) % 3 = 0) OR day(open_time) = 17)
  THEN open END AS open FROM bars)"""


def opinions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    pick = lambda n, values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % n + 1).cast("int"))
    return e.select(F.col("event_id").alias("opinion_id"), F.col("user_id").alias("author_id"),
                    F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("instrument"),
                    pick(4, ["LONG", "SHORT", "FLAT", "UNKNOWN"]).alias("stance"), pick(6, ["15m", "1h", "4h", "1d", None, "30m"]).alias("horizon"),
                    ((F.col("event_id") * 37) % 101 / 100.0).alias("confidence"), (F.col("event_id") % 13 != 0).alias("trusted"), F.col("ts").alias("effective_at"), "value")


OPINIONS = """opinions AS (SELECT event_id AS opinion_id, user_id AS author_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS instrument,
  (['LONG', 'SHORT', 'FLAT', 'UNKNOWN'])[event_id % 4 + 1] AS stance, (['15m', '1h', '4h', '1d', NULL, '30m'])[event_id % 6 + 1] AS horizon,
  ((event_id * 37) % 101) / 100.0 AS confidence, event_id % 13 <> 0 AS trusted, ts AS effective_at, value FROM events)"""


def macro(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderpriority").alias("event_code"), F.col("o_orderstatus").alias("country"), F.date_trunc("month", "o_orderdate").alias("event_at"),
                    F.col("o_orderdate").alias("released_at"), F.col("o_orderkey").alias("release_id"),
                    F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate") + F.expr("interval 5 days")).alias("vintage_end_at"),
                    F.col("o_totalprice").alias("actual_value"))


MACRO = """macro AS (SELECT o_orderpriority AS event_code, o_orderstatus AS country, date_trunc('month', o_orderdate) AS event_at, o_orderdate AS released_at,
  o_orderkey AS release_id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL 5 DAY END AS vintage_end_at, o_totalprice AS actual_value FROM orders)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    status = F.when(F.col("event_id") % 5 < 3, "SUCCESS").when(F.col("event_id") % 5 == 3, "FAILED").otherwise("PARTIAL_FAILED")
    return e.select((F.col("user_id") % 20).alias("source"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), status.alias("status"),
                    (F.col("event_id") % 9).alias("inserted"), (F.col("event_id") % 4).alias("failed"))


RUNS = """runs AS (SELECT user_id % 20 AS source, event_id AS run_id, ts AS started_at,
  CASE WHEN event_id % 5 < 3 THEN 'SUCCESS' WHEN event_id % 5 = 3 THEN 'FAILED' ELSE 'PARTIAL_FAILED' END AS status,
  event_id % 9 AS inserted, event_id % 4 AS failed FROM events)"""


def posts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("post_id"), "text", "lang", "source", F.col("n_chars"),
        F.expr("timestampadd(MINUTE, cast(doc_id as int), timestamp_ntz'2024-01-01 00:00:00')").alias("published_at"),
        F.expr("timestampadd(MINUTE, cast(doc_id + 5 as int), timestamp_ntz'2024-01-01 00:00:00')").alias("collected_at"))


POSTS = """posts AS (SELECT doc_id AS post_id, text, lang, source, n_chars, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS published_at,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id + 5) AS collected_at FROM documents)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Three annotators' values of two fields for each labelled document."""
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    v = lambda c: F.nullif(c, F.lit(""))
    rows = F.array(
        F.struct(F.lit("quality").alias("field"), F.col("quality").cast("string").alias("gold"), F.col("quality").cast("string").alias("a"),
                 F.when(F.col("n_chars") % 5 == 0, "").otherwise((F.col("n_chars") % 2).cast("string")).alias("b"),
                 F.when(F.col("doc_id") % 4 == 0, F.col("lang")).otherwise(F.col("quality").cast("string")).alias("c")),
        F.struct(F.lit("lang").alias("field"), F.col("lang").alias("gold"), F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.col("lang")).alias("a"),
                 F.when(F.col("n_chars") % 3 == 0, "en").otherwise(F.col("lang")).alias("b"), F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.lit("en")).alias("c")))
    c = j.select("doc_id", "source", F.explode(rows).alias("x")).select(F.col("doc_id").alias("post_id"), "source", "x.*")
    return c.select("post_id", "source", "field", "gold", *[v(F.col(x)).alias(x) for x in "abc"])


CELLS = """cells AS (SELECT doc_id AS post_id, source, 'quality' AS field, CAST(quality AS VARCHAR) AS gold, CAST(quality AS VARCHAR) AS a,
  nullif(CASE WHEN n_chars % 5 = 0 THEN '' ELSE CAST(n_chars % 2 AS VARCHAR) END, '') AS b,
  CASE WHEN doc_id % 4 = 0 THEN lang ELSE CAST(quality AS VARCHAR) END AS c FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, source, 'lang', lang, nullif(CASE WHEN doc_id % 6 = 0 THEN '' ELSE lang END, ''),
  CASE WHEN n_chars % 3 = 0 THEN 'en' ELSE lang END, nullif(CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'en' END, '') FROM labels JOIN documents USING (doc_id))"""
