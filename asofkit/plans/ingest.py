"""Queries over payload tables that Spark derives from the given tables, extraction, models and streams."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import extract, health, labels, signal, skill, store, windows
from ..sources import payloads
from ..streaming import streams
from . import adapters as a

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


r6 = lambda c: F.round(c, 6).alias(c)
T = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _chart(spark, d):
    """Each instrument's day of hourly bars as a chart response; some bars are broken."""
    b = a.bars_1h(spark, d).withColumn("epoch", F.unix_seconds(F.col("open_time").cast("timestamp")))
    b = b.withColumn("high", F.when(F.hour("open_time") % 7 == 0, F.col("low") - 1).otherwise(F.col("high"))).withColumn("open", F.when(F.hour("open_time") % 5 == 0, F.lit(None)).otherwise(F.col("open")))
    g = b.groupBy("instrument", F.to_date("open_time").alias("day")).agg(F.array_sort(F.collect_list(F.struct("epoch", "open", "high", "low", "close", "volume"))).alias("x"))
    quote = F.struct(*[F.col(f"x.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    chart = F.struct(F.array(F.struct(F.col("x.epoch").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))).alias("result"))
    return g.select(F.lit("chart").alias("source"), "instrument", F.to_json(F.struct(chart.alias("chart")), {"ignoreNullFields": "false"}).alias("body"))


_BROKEN = f"""{a.BARS}, x AS (SELECT instrument, open_time, close_time, CASE WHEN hour(open_time) % 5 = 0 THEN NULL ELSE open END AS open, CASE WHEN hour(open_time) % 7 = 0 THEN low - 1 ELSE high END AS high, low, close, volume FROM bars)"""


@query(f"WITH {_BROKEN} SELECT instrument, {T('open_time')} AS open_time, open, high, low, close, CAST(volume AS DOUBLE) AS volume FROM x WHERE open IS NOT NULL AND high >= greatest(open, close) AND low <= least(open, close) AND least(open, high, low, close) > 0 AND close_time <= TIMESTAMP '2024-01-20'")
def chart_payload_bars(spark, d):
    bars, _ = payloads.chart_bars(_chart(spark, d), 3600, F.expr("timestamp'2024-01-20 00:00:00'"))
    return bars.select("instrument", a.stamp("open_time").alias("open_time"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"))


@query(f"""WITH {_BROKEN} SELECT CASE WHEN open IS NULL THEN 'missing_price' WHEN least(open, high, low, close) <= 0 THEN 'not_positive' WHEN high < greatest(open, close) OR low > least(open, close) THEN 'bounds' ELSE 'unclosed' END AS why, count(*) AS n
FROM x WHERE NOT coalesce(open IS NOT NULL AND high >= greatest(open, close) AND low <= least(open, close) AND least(open, high, low, close) > 0 AND close_time <= TIMESTAMP '2024-01-20', false) GROUP BY ALL""")
def chart_payload_drops(spark, d):
    return payloads.chart_bars(_chart(spark, d), 3600, F.expr("timestamp'2024-01-20 00:00:00'"))[1]


@query(f"WITH {_BROKEN} SELECT instrument, count(*) AS slots, count(*) FILTER (WHERE open IS NULL) AS without_price FROM x GROUP BY instrument")
def chart_payload_slots(spark, d):
    return payloads.chart_slots(_chart(spark, d)).groupBy("instrument").agg(F.count(F.lit(1)).alias("slots"), F.count_if(F.col("open").isNull()).alias("without_price"))


@query(f"""WITH o AS (SELECT o_orderpriority AS code, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, CAST(o_orderdate AS DATE) + 1 AS rel, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS DATE) + 6 END AS ends,
  CASE WHEN o_orderkey % 5 <> 0 THEN round(o_totalprice, 2) END AS v FROM orders) SELECT code AS event_code, CAST(day AS VARCHAR) AS event_at, CAST(rel AS VARCHAR) AS released_at, min(v) AS value FROM o WHERE v IS NOT NULL AND day <= DATE '1997-06-01' GROUP BY ALL""")
def macro_payload_releases(spark, d):
    o = a.table(spark, d, "orders")
    s = F.struct(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("date"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("realtime_start"),
                 F.when(F.col("o_orderkey") % 7 == 0, F.date_format(F.date_add("o_orderdate", 5), "yyyy-MM-dd")).otherwise("9999-12-31").alias("realtime_end"),
                 F.when(F.col("o_orderkey") % 5 == 0, ".").otherwise(F.round("o_totalprice", 2).cast("decimal(20,2)").cast("string")).alias("value"))
    p = o.groupBy(F.col("o_orderpriority").alias("series"), F.year("o_orderdate").alias("y")).agg(F.collect_list(s).alias("observations"))
    p = p.select(F.lit("m").alias("source"), "series", F.to_json(F.struct("observations")).alias("body"))
    m = payloads.macro_observations(p, F.expr("timestamp'1997-06-01 00:00:00'"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return m.select("event_code", day("event_at"), day("released_at"), F.col("actual_value").cast("double").alias("value"))


@query(f"WITH {a.POSTS} SELECT DISTINCT source, CAST(post_id AS VARCHAR) AS source_record_id, 'T ' || lang AS title, {T('published_at')} AS published_at FROM posts")
def feed_payload_entries(spark, d):
    p = a.posts(spark, d)
    item = F.concat(F.lit("<item><guid>"), F.col("post_id").cast("string"), F.lit("</guid><title>T &lt;b&gt;"), "lang", F.lit("&lt;/b&gt;</title><pubDate>"),
                    F.date_format("published_at", "d MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    g = p.groupBy("source", F.floor(F.col("post_id") / 100).alias("b")).agg(F.array_join(F.collect_list(item), "").alias("items"))
    feeds = g.select("source", F.concat(F.lit("<rss><channel>"), "items", F.lit("</channel></rss>")).alias("body"))
    return payloads.feed_entries(feeds).select("source", "source_record_id", "title", a.stamp("published_at").alias("published_at"))


@query("""SELECT doc_id AS row_id, 'quality' AS field, CAST(quality AS VARCHAR) AS gold, CASE WHEN quality IS NULL THEN 'missing label' END AS skip_reason FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR), CASE WHEN toxic IS NULL THEN 'missing label' END FROM documents LEFT JOIN labels USING (doc_id)""")
def benchmark_cells(spark, d):
    rows = a.table(spark, d, "documents").join(a.table(spark, d, "labels"), "doc_id", "left").withColumnRenamed("doc_id", "row_id")
    return payloads.benchmark_cells(rows, "text", {"quality": "quality", "toxic": "toxic"}).select("row_id", "field", "gold", "skip_reason")


#: What a post says behind its text, by doc_id % 12, with prices {p}, {s} and {t} made of its columns.
SAID = ["gold long near {p}, stop {s}, target {t}, intraday. cpi was hot", "白银看空 {p} 附近，止损 {t}，目标 {s}，本周", "if btc breaks {p}, buy oil. wait in the range {s}-{t}",
        "我认为黄金看涨，日内目标 {t}", "专家认为黄金看涨，目标 {t}", "不看多黄金，30分钟", "maybe buy silver from {s} - {t}, scalp. see chart", "long gold, sell oil, hours, stop {t}",
        "yesterday short at {p}", "buy XPTUSD at {p}, BUDGET is fine, stop {t}", "看图，{p}", "{p} 点做多，{s} 止损，黄金或白银观望"]


def _opinion_posts(spark, d):
    rows = a.table(spark, d, "documents").select(F.col("doc_id").alias("post_id"), "text", (F.lit(1000) + F.coalesce("n_chars", F.lit(0)) % 500).alias("p"))
    price = {"{p}": F.col("p"), "{s}": F.col("p") - 20, "{t}": F.col("p") + 35}
    said = [F.concat(*[price[x].cast("string") if x in price else F.lit(x) for x in re.split(r"(\{[pst]\})", s) if x]) for s in SAID]
    return rows.select("post_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.get(F.array(*said), (F.col("post_id") % 12).cast("int"))).alias("text"))


_PRICED = "SELECT doc_id AS post_id, doc_id % 12 AS k, CAST(1000 + coalesce(n_chars, 0) % 500 AS DOUBLE) AS p, p - 20 AS s, p + 35 AS t FROM documents"
#: What is read from each phrase; the letters stand for the prices.
_READ = """(VALUES (0, 'LONG', '1h', 'XAUUSD', 'TECHNICAL', 0.9, 'p', 'p', 's', 't', ''), (1, 'SHORT', '1d', 'XAGUSD', 'TECHNICAL', 0.9, 'p', 'p', 't', 's', ''),
  (2, 'UNKNOWN', NULL, 'BTCUSD', NULL, NULL, '', '', '', '', 'conditional'), (2, 'UNKNOWN', NULL, 'WTI', NULL, NULL, '', '', '', '', 'conditional'),
  (2, 'FLAT', NULL, NULL, 'TECHNICAL', 0.6, 's', 't', '', '', ''), (3, 'LONG', '1h', 'XAUUSD', 'TECHNICAL', 0.9, '', '', '', 't', ''),
  (4, 'UNKNOWN', NULL, 'XAUUSD', NULL, NULL, '', '', '', '', 'quote-only'), (5, 'UNKNOWN', '30m', 'XAUUSD', NULL, NULL, '', '', '', '', 'negated_direction'),
  (6, 'LONG', '15m', 'XAGUSD', 'TECHNICAL', 0.4, 's', 't', '', '', 'weak_language'), (7, 'LONG', '4h', 'XAUUSD', 'OTHER', 0.7, '', '', '', '', ''),
  (7, 'SHORT', '4h', 'WTI', 'TECHNICAL', 0.9, '', '', 't', '', ''), (8, 'UNKNOWN', NULL, NULL, NULL, NULL, '', '', '', '', 'post-hoc'),
  (9, 'LONG', NULL, 'XPTUSD', 'TECHNICAL', 0.9, 'p', 'p', '', '', 'price_dropped'), (11, 'LONG', NULL, NULL, 'TECHNICAL', 0.9, 's', 's', '', '', 'price_dropped'),
  (11, 'FLAT', NULL, 'XAUUSD', 'OTHER', 0.6, '', '', '', '', ''), (11, 'FLAT', NULL, 'XAGUSD', 'OTHER', 0.6, '', '', '', '', ''))
  x(k, stance, horizon, instrument, information_type, confidence, lo, hi, sl, tp, diagnostics)"""
_VALUE = "CASE {0} WHEN 'p' THEN p WHEN 's' THEN s WHEN 't' THEN t END"


@query(f"""WITH d AS ({_PRICED}) SELECT post_id, (['LONG', 'SHORT', 'LONG', 'LONG', 'LONG', 'LONG', 'LONG', 'LONG', 'SHORT', 'LONG', NULL, 'LONG'])[k + 1] AS stance,
  CASE k WHEN 0 THEN 'MACRO' END AS information_type FROM d""")
def opinion_columns(spark, d):
    """Stance and information type of every whole post."""
    return _opinion_posts(spark, d).select("post_id", extract.stance_column(F.col("text")).alias("stance"), extract.information_type_column(F.col("text")).alias("information_type"))


@query(f"""WITH d AS ({_PRICED}) SELECT post_id, stance, horizon, instrument, information_type, CAST(confidence AS DOUBLE) AS confidence, {_VALUE.format('lo')} AS entry_low, {_VALUE.format('hi')} AS entry_high,
  {_VALUE.format('sl')} AS stop_loss, {_VALUE.format('tp')} AS take_profit, diagnostics, CASE instrument WHEN 'XPTUSD' THEN 'unknown_instrument' ELSE '' END AS warnings FROM d JOIN {_READ} USING (k)""")
def extracted_opinions(spark, d):
    o = extract.extract_opinions(_opinion_posts(spark, d))[1]
    return o.select("post_id", "stance", "horizon", "instrument", "information_type", "confidence", "entry_low", "entry_high", "stop_loss", "take_profit",
                    F.array_join("diagnostics", ",").alias("diagnostics"), F.array_join("warnings", ",").alias("warnings"))


@query("SELECT 'SUCCESS' AS status, CASE WHEN doc_id % 12 = 10 THEN 'image_only' END AS reason, CAST(sum(CASE WHEN doc_id % 12 IN (2, 7, 11) THEN 2 WHEN doc_id % 12 = 10 THEN 0 ELSE 1 END) AS BIGINT) AS units, count(*) AS n FROM documents GROUP BY ALL")
def extraction_status(spark, d):
    done = extract.extract_opinions(_opinion_posts(spark, d))[0]
    return done.groupBy("status", "reason").agg(F.sum("n_units").alias("units"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {a.POSTS} SELECT post_id FROM posts WHERE post_id % 3 <> 0")
def pending_posts(spark, d):
    p = a.posts(spark, d)
    done = p.where("post_id % 3 = 0").select("post_id", F.lit("v2").alias("parser_version")).unionByName(p.select("post_id", F.lit("v1").alias("parser_version")))
    return extract.pending_posts(p, done, "v2").select("post_id")


@query()
def technical_signal(spark, d):
    """Logistic regression on window features, judged on the untouched last fifth of each instrument."""
    f = windows.return_features(a.bars_1h(spark, d), ["instrument"])
    f = labels.simple_label(f, ["instrument"], 4).where("label is not null and volatility is not null")
    parts = windows.time_split(f, ["instrument"], [F.col("open_time")], 24, minimum=100, strict=False).withColumn("hit", F.col("label") > 0)
    test = signal.fit_signal(parts, ["log_return", "momentum", "mean_gap", "volatility", "breakout"], "hit")
    return skill.signal_metrics(test, ["instrument"], "p", "hit", "p", "label")


@query(f"""WITH {a.BARS}, g AS (SELECT instrument, time_bucket(INTERVAL 4 HOUR, open_time) AS b, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close, count(*) AS n
  FROM bars GROUP BY ALL), last AS (SELECT max(open_time) AS m FROM bars) SELECT instrument, {T('b')} AS open_time, open, high, low, close FROM g, last WHERE n = 4 AND b + INTERVAL 4 HOUR <= last.m - INTERVAL 1 HOUR""")
def streamed_bars_4h(spark, d):
    """The streaming bars over hourly bars that arrive as files; what the watermark has closed."""
    path = a.folder(spark, "bars")
    b = a.bars_1h(spark, d).select("instrument", "open_time", "open", "high", "low", "close", "volume")
    b.write.parquet(f"{path}/in")
    stream = streams.complete_bars_stream(spark.readStream.schema(b.schema).parquet(f"{path}/in"), "4 hours", 4, "1 hour")
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/q").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{path}/out")
    return out.select("instrument", a.stamp("open_time").alias("open_time"), "open", "high", "low", "close")


@query(f"WITH {a.POSTS} SELECT post_id, {T('published_at')} AS published_at, {T('greatest(published_at, collected_at)')} AS effective_at, {T('time_bucket(INTERVAL 30 MINUTE, published_at)')} AS slot, n_chars > 1000 AS \"cut\" FROM posts")
def effective_times(spark, d):
    p = a.posts(spark, d)
    return p.select("post_id", a.stamp("published_at").alias("published_at"), a.stamp(tx.effective_time(F.col("published_at"), F.col("collected_at"))).alias("effective_at"),
                    a.stamp(tx.slot_floor(F.col("published_at"))).alias("slot"), (F.col("n_chars") > 1000).alias("cut"))


@query()
def normalized_numbers(spark, d):
    cents = F.col("o_orderkey") * 100 % 977
    text = F.concat(F.lit("about "), (cents / F.lit(100.0)).cast("decimal(10,2)").cast("string"), F.lit(" usd"))
    return a.table(spark, d, "orders").select("o_orderkey", tx.normalize_number(text).alias("number"))


ORACLE["normalized_numbers"] = """SELECT o_orderkey, rtrim(rtrim(CAST(CAST((o_orderkey * 100 % 977) / 100.0 AS DECIMAL(10,2)) AS VARCHAR), '0'), '.') AS number FROM orders"""


@query("SELECT page_id, coalesce(regexp_matches(url, '^https://[^/?#@]+([/?#]|$)'), false) AS valid FROM pages")
def reference_validity(spark, d):
    return a.table(spark, d, "pages").select("page_id", F.coalesce(tx.valid_reference(F.col("url")), F.lit(False)).alias("valid"))


@query(f"WITH {a.RUNS} SELECT source, run_id FROM runs WHERE run_id % 2 = 1")
def versioned_append(spark, d):
    r = a.runs(spark, d).select("source", "run_id", "inserted")
    return store.append_versioned(r, r.where("run_id % 2 = 0"), ["run_id"], ["source", "inserted"]).select("source", "run_id")


@query("SELECT event_type AS kind, count(*) FILTER (WHERE event_id % 10 < 7) AS accepted, count(*) FILTER (WHERE event_id % 10 = 7) AS duplicate, count(*) FILTER (WHERE event_id % 10 = 8) AS rejected, count(*) FILTER (WHERE event_id % 10 = 9) AS failed, coalesce(string_agg(DISTINCT CASE WHEN event_id % 10 = 8 THEN 'late ' || (user_id % 3) END, ',' ORDER BY CASE WHEN event_id % 10 = 8 THEN 'late ' || (user_id % 3) END), '') AS warnings FROM events GROUP BY ALL")
def processing_report(spark, d):
    e = a.table(spark, d, "events")
    o = e.select(F.col("event_type").alias("kind"), F.when(F.col("event_id") % 10 < 7, "ACCEPTED").when(F.col("event_id") % 10 == 7, "DUPLICATE").when(F.col("event_id") % 10 == 8, "REJECTED").otherwise("FAILED").alias("outcome"), F.when(F.col("event_id") % 10 == 8, F.concat(F.lit("late "), (F.col("user_id") % 3).cast("string"))).alias("warning"))
    return health.processing_report(o, ["kind"]).withColumn("warnings", F.array_join(F.array_sort("warnings"), ","))
