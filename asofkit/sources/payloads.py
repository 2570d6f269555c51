"""Sources: tables of raw payloads (one row per response or file) become typed rows."""

from __future__ import annotations

import lzma
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import feed_time, strip_html
from ..operators.bars import reasons

CHART = ("struct<chart: struct<error: struct<code: string>, result: array<struct<timestamp: array<bigint>, indicators: struct<quote: "
         "array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>>>>>>>")


def chart_points(payloads: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """Chart JSON -> one row per time with its prices, nulls kept; payloads with an error raise."""
    keep = keep or ["source", "instrument"]
    p = payloads.select(*keep, F.from_json(body, CHART).alias("j"))
    broken = F.col("j.chart.result").isNull() | (F.size("j.chart.result") == 0)
    r = p.withColumn("r", F.when(broken, F.raise_error(F.lit("chart payload without a result"))).otherwise(F.col("j.chart.result")[0]))
    q = F.col("r.indicators.quote")[0]
    zipped = F.arrays_zip(F.col("r.timestamp").alias("epoch"), *[q[c].alias(c) for c in ("open", "high", "low", "close", "volume")])
    points = r.select(*keep, F.posexplode(zipped).alias("pos", "z"))
    return points.select(*keep, "pos", *[F.col("z").getField(n).alias(c) for n, c in zip(["epoch", "open", "high", "low", "close", "volume"], ["epoch", "open", "high", "low", "close", "volume"])])


def chart_bars(payloads: DataFrame, step_seconds: int, not_after, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(closed bars, counts of what was dropped by reason); the first of equal times wins."""
    keep = keep or ["source", "instrument"]
    pts = chart_points(payloads, keep=keep)
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))  # noqa: E741
    repeat = F.row_number().over(Window.partitionBy(*keep, "epoch").orderBy("pos")) > 1
    close_time = F.timestamp_seconds(F.col("epoch") + step_seconds)
    bad = reasons(bad_epoch=F.col("epoch").isNull() | (F.col("epoch") <= 0), missing_price=o.isNull() | h.isNull() | l.isNull() | c.isNull(),
                  not_positive=F.least(o, h, l, c) <= 0, bounds=(h < F.greatest(o, c)) | (l > F.least(o, c)))
    d = pts.withColumn("__r", bad).withColumn("__d", repeat).withColumn("open_time", F.timestamp_seconds("epoch")).withColumn("close_time", close_time)
    why = (F.when(F.size("__r") > 0, F.col("__r")[0]).when(F.col("close_time") > not_after, "unclosed"))
    d = d.withColumn("why", why)
    n = F.row_number().over(Window.partitionBy(*keep, "epoch").orderBy("pos"))
    fine = d.where("why is null").withColumn("__n", n)
    bars = fine.where("__n = 1").select(*keep, "open_time", "close_time", "open", "high", "low", "close", "volume")
    dropped = d.where("why is not null").select("why").unionByName(fine.where("__n > 1").select(F.lit("duplicate").alias("why")))
    return bars, dropped.groupBy("why").agg(F.count(F.lit(1)).alias("n"))


def chart_slots(payloads: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Slots for the gap audit: only rows without a valid time go; missing prices stay."""
    pts = chart_points(payloads, keep=keep)
    return pts.where("epoch > 0").withColumn("open_time", F.timestamp_seconds("epoch")).drop("pos", "epoch")


MACRO_JSON = "struct<observations: array<struct<date: string, realtime_start: string, realtime_end: string, value: string>>>"


def macro_observations(payloads: DataFrame, now, initial_only: bool = False) -> DataFrame:
    """Macro JSON (source, series, body) -> releases.

    A value is usable from midnight after its release day; an open vintage end is null. Missing
    values, future dates and repeats go; a vintage that ends before its release raises.
    """
    o = payloads.select("source", F.col("series").alias("event_code"), F.explode(F.from_json("body", MACRO_JSON)["observations"]).alias("o")).select("source", "event_code", "o.*")
    day = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd"))
    end = F.when((F.col("realtime_end") != "9999-12-31") & ~F.lit(initial_only), day("realtime_end") + F.expr("interval 1 day"))
    d = o.select("source", "event_code", day("date").alias("event_at"), (day("realtime_start") + F.expr("interval 1 day")).alias("released_at"), end.alias("vintage_end_at"),
                 F.expr("try_cast(value as decimal(28,10))").alias("actual_value"))
    d = d.where(F.col("actual_value").isNotNull() & (F.col("event_at") <= now))
    d = d.withColumn("released_at", F.when(F.col("vintage_end_at") <= F.col("released_at"), F.raise_error(F.lit("vintage ends before its release"))).otherwise(F.col("released_at")))
    n = F.row_number().over(Window.partitionBy("source", "event_code", "event_at", "released_at").orderBy("actual_value"))
    return d.withColumn("__n", n).where("__n = 1").drop("__n")


def macro_csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, schema="series_id string, date string, released_at string, value string", enforceSchema=False)
    return df.select(F.col("series_id").alias("event_code"), F.try_to_timestamp("date", F.lit("yyyy-MM-dd")).alias("event_at"),
                     F.try_to_timestamp("released_at").alias("released_at"), F.expr("try_cast(value as decimal(28,10))").alias("actual_value")).where("actual_value is not null")


def aggregator_rows(payloads: DataFrame) -> DataFrame:
    """Aggregator JSON: period texts of several forms; without release times the event time counts."""
    s = "struct<docs: array<struct<dataset: string, series_code: string, period: array<string>, value: array<double>>>>"
    d = payloads.select("source", F.explode(F.from_json("body", s)["docs"]).alias("d"))
    d = d.select("source", F.concat_ws(":", "d.dataset", "d.series_code").alias("event_code"), F.explode(F.arrays_zip(F.col("d.period").alias("p"), F.col("d.value").alias("v"))).alias("z"))
    quarter = F.regexp_extract("z.p", r"^(\d{4})-Q([1-4])$", 1)
    month = F.when(quarter != "", F.concat(quarter, F.lit("-"), F.lpad(((F.expr("try_cast(regexp_extract(z.p, '^([0-9]{4})-Q([1-4])$', 2) as int)") - 1) * 3 + 1).cast("string"), 2, "0")))
    at = F.coalesce(F.try_to_timestamp("z.p", F.lit("yyyy-MM-dd")), F.try_to_timestamp("z.p", F.lit("yyyy-MM")), F.try_to_timestamp(month, F.lit("yyyy-MM")), F.try_to_timestamp("z.p", F.lit("yyyy")))
    return d.select("source", "event_code", at.alias("event_at"), at.alias("released_at"), F.col("z.v").alias("actual_value")).where("event_at is not null and actual_value is not null")


def news_search(payloads: DataFrame) -> DataFrame:
    s = "struct<data: array<struct<id: string, engineType: string, title: string, link: string, publishedAt: string>>>"
    d = payloads.select("source", F.explode(F.from_json("body", s)["data"]).alias("n")).select("source", "n.*")
    return d.where("engineType = 'news' and trim(coalesce(title, '')) <> ''").select("source", F.col("id").alias("source_record_id"), "title", F.col("link").alias("source_url"), F.col("publishedAt").alias("published_text"))


def _feed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xml.etree.ElementTree as ET

    def name(e):
        return e.tag.rpartition("}")[2]

    def first(e, *names):
        for child in e:
            if name(child) in names:
                if name(child) == "link" and child.get("href"):
                    return child.get("href")
                return "".join(child.itertext())
        return None
    for pdf in batches:
        rows = []
        for source, body in zip(pdf["source"], pdf["body"]):
            try:
                root = ET.fromstring(body or "")
            except ET.ParseError:
                rows.append((source, None, None, None, None, None, False, "BROKEN_FEED", 0))
                continue
            for i, e in enumerate(x for x in root.iter() if name(x) in ("item", "entry")):
                link = first(e, "link")
                media = any(name(x) in ("enclosure", "content", "thumbnail") and x.get("url") for x in e)
                rows.append((source, first(e, "guid", "id") or link, first(e, "title"), first(e, "description", "summary", "content"), link,
                             first(e, "pubDate", "published", "updated", "date"), media, None, i))
        yield pd.DataFrame(rows, columns=["source", "source_record_id", "title", "body", "source_url", "published_text", "has_media", "problem", "pos"])


def feed_entries(payloads: DataFrame, max_items: int = 200) -> DataFrame:
    """RSS and Atom payloads -> entries, the first of equal ids, html stripped; a broken feed is a row with a problem."""
    d = payloads.select("source", "body").mapInPandas(_feed, "source string, source_record_id string, title string, body string, source_url string, published_text string, has_media boolean, problem string, pos int")
    n = F.row_number().over(Window.partitionBy("source", "source_record_id").orderBy("pos"))
    at, ambiguous = feed_time(F.trim("published_text"))
    return (d.withColumn("__n", n).where((F.col("__n") == 1) & (F.col("pos") < max_items)).withColumn("title", strip_html(F.col("title"))).withColumn("body", strip_html(F.col("body")))
            .withColumn("published_at", at).withColumn("ambiguous_time", ambiguous).drop("__n", "pos"))


_CANDLE = ">5if"  # second, open, close, low, high, volume


def _minutes(scale: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                raw = lzma.decompress(content) if len(content) else b""
                if len(raw) % struct.calcsize(_CANDLE):
                    raise ValueError(f"{path}: size is no multiple of a record")
                rows = list(struct.iter_unpack(_CANDLE, raw))
                out = pd.DataFrame(rows, columns=["second", "open", "close", "low", "high", "volume"])
                s = out["second"]
                if (s % 60 != 0).any() or (s.diff().dropna() <= 0).any():
                    raise ValueError(f"{path}: seconds are no increasing minutes")
                out[["open", "close", "low", "high"]] /= scale
                if (out["low"] <= 0).any() or (out["high"] < out[["open", "close"]].max(axis=1)).any() or (out["low"] > out[["open", "close"]].min(axis=1)).any():
                    raise ValueError(f"{path}: inconsistent price")
                out.insert(0, "path", path)
                yield out
    return run


def minute_files(files: DataFrame, scale: float = 1000.0) -> DataFrame:
    """Compressed day files (path, content) of fixed-width big-endian minute records -> rows; damage raises."""
    return files.select("path", "content").mapInPandas(_minutes(scale), "path string, second int, open double, close double, low double, high double, volume double")


def _gb18030(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import csv
    import io

    for pdf in batches:
        for content in pdf["content"]:
            rows = csv.DictReader(io.StringIO(content.decode("gb18030")))
            yield pd.DataFrame({"r": [{(k or "").strip().lower(): v for k, v in row.items() if isinstance(v, str)} for row in rows]})


def corpus_csv(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """Corpus files in UTF-8 or, where their bytes are not, in GB18030, with aliased columns.

    Spark's reader takes the UTF-8 files of the folder; the others, the exception, are decoded a
    file at a time in tasks.
    """
    from ..operators.evidence import canonical_columns

    files = spark.read.format("binaryFile").load(path).where("length > 0").withColumn("utf8", F.is_valid_utf8(F.col("content").cast("string")))
    plain = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"').withColumn("__file", F.regexp_replace(F.input_file_name(), "^file:/+", "/"))
    name = F.regexp_replace("path", "^file:/+", "/").alias("__file")
    utf8 = canonical_columns(plain, aliases | {"__file": []})[0].join(files.where("utf8").select(name), "__file", "left_semi").select(*aliases)
    maps = files.where("not utf8").select("content").mapInPandas(_gb18030, "r map<string,string>")
    pick = [F.coalesce(*[F.nullif(F.trim(F.try_element_at("r", F.lit(x.lower()))), F.lit("")) for x in (target, *others)]).alias(target) for target, others in aliases.items()]
    return utf8.unionByName(maps.select(*pick))


def _rejected(df: DataFrame, record: str) -> DataFrame:
    """(file, reason, digest): what was wrong and where; the record itself is not kept, as it may hold anything."""
    return df.where("reason is not null").select("file", "reason", F.sha2(F.col(record), 256).alias("digest"))


def quarantined_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of files of JSON lines: a line that is no object of the schema is kept apart, not fatal. Blank lines are none."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(F.trim("value") != "")
    parsed = F.try_parse_json("value")
    df = lines.withColumn("r", F.from_json("value", f"{schema}, _corrupt_record string", options))
    df = df.withColumn("reason", F.when(parsed.isNull(), "broken_json").when(~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), "not_an_object")
                       .when(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull(), "wrong_type"))
    return df.where("reason is null").select("r.*").drop("_corrupt_record"), _rejected(df, "value")


def quarantined_csv(spark: SparkSession, path: str, schema: StructType, required: list[str] | None = None, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of CSV files, with a header or without; fields may hold line ends.

    A row with too few or too many fields is ``malformed``, one whose text is no value of a column's type
    ``bad_value:column``, one without a required column's value ``missing:column``; the first reason counts. Columns
    are taken by their place in the schema.
    """
    names = schema.fieldNames()
    text = StructType([*[StructField(n, StringType()) for n in names], StructField("_corrupt_record", StringType())])
    raw = (spark.read.schema(text).csv(path, header=header, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
           .select("*", F.col("_metadata.file_name").alias("file")))
    typed = raw.select(*[F.col(f"`{n}`").alias(f"__t_{n}") for n in names], *[F.expr(f"try_cast(trim(`{f.name}`) AS {f.dataType.simpleString()})" if not isinstance(f.dataType, StringType)
                       else f"`{f.name}`").alias(f.name) for f in schema.fields], "_corrupt_record", "file")
    blank = lambda n: F.trim(F.coalesce(F.col(f"__t_{n}"), F.lit(""))) == ""
    reasons = [F.when(F.col("_corrupt_record").isNotNull(), "malformed"), *[F.when(~blank(n) & F.col(n).isNull(), f"bad_value:{n}") for n in names],
               *[F.when(blank(n), f"missing:{n}") for n in required or []]]
    judged = typed.withColumn("reason", F.coalesce(*reasons)).withColumn("record", F.coalesce("_corrupt_record", F.to_json(F.array(*[f"__t_{n}" for n in names]))))
    return judged.where("reason is null").select(*names), _rejected(judged, "record")


def benchmark_cells(rows: DataFrame, text: str, flags: dict[str, str]) -> DataFrame:
    """Labelled headlines -> one cell per field; a missing label gives a skipped row with its reason."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("gold"), F.when(F.col(c).isNull(), "missing label").alias("skip_reason")) for f, c in flags.items()])
    return rows.select("row_id", F.col(text).alias("text"), F.explode(cells).alias("c")).select("row_id", "text", "c.*")


def probe_rows(payloads: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Chart rows with all four prices; a missing volume is NaN, not null."""
    pts = chart_points(payloads, keep=keep)
    whole = pts.where(F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull())
    return whole.withColumn("volume", F.coalesce(F.col("volume").cast("double"), F.lit(float("nan"))))


def daily_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars, skipped) of text rows (instrument, date, open, high, low, close, volume).

    A price or date that is missing or no number is an error, since it says that the source has
    changed; prices that contradict each other are a row to skip.
    """
    number = lambda c: F.col(c).try_cast("decimal(20,8)")
    day = F.try_to_timestamp("date", F.lit("yyyy-MM-dd"))
    broken = day.isNull() | number("open").isNull() | number("high").isNull() | number("low").isNull() | number("close").isNull()
    d = rows.select("instrument", F.when(broken, F.raise_error(F.concat(F.lit("unreadable daily row "), F.to_json(F.struct(*rows.columns))))).otherwise(day).alias("open_time"),
                    *[number(c).alias(c) for c in ("open", "high", "low", "close", "volume")])
    d = d.withColumn("close_time", F.col("open_time") + F.expr("interval 1 day"))
    fine = ((F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close")) & (F.least("open", "high", "low", "close") > 0)
            & (F.coalesce("volume", F.lit(0)) >= 0))
    return d.where(fine), d.where(~fine)


def _read_csv(spark: SparkSession, path: str, need: list[str]) -> DataFrame:
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    if lacking := sorted(set(need) - set(df.columns)):
        raise ValueError(f"columns missing: {lacking}")
    return df


def news_csv(spark: SparkSession, path: str) -> DataFrame:
    """News from CSV with record_id, title, published_at and maybe summary or content, link, category. A time without a zone is ambiguous."""
    from ..functions import text as tx

    df = _read_csv(spark, path, ["record_id", "title", "published_at"])
    col = lambda *names: F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names if n in df.columns], F.lit(None).cast("string"))
    at, ambiguous = tx.feed_time(F.trim("published_at"))
    title, text = tx.strip_html(F.coalesce(col("title"), F.lit(""))), tx.strip_html(F.coalesce(col("summary", "content"), F.lit("")))
    return df.select(F.coalesce(col("record_id"), tx.content_hash(title, text)).alias("source_record_id"), title.alias("title"), text.alias("text"), col("link").alias("source_url"),
                     F.when(col("category").isNotNull(), F.array(col("category"))).otherwise(F.array().cast("array<string>")).alias("categories"), at.alias("published_at"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"))


def offline_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV with open_time, open, high, low, close and maybe volume; an unreadable time is an error."""
    df = _read_csv(spark, path, ["open_time", "open", "high", "low", "close"])
    at = F.coalesce(F.try_to_timestamp("open_time"), F.raise_error(F.concat(F.lit("unreadable time "), F.coalesce("open_time", F.lit("null")))))
    volume = F.col("volume").cast("double") if "volume" in df.columns else F.lit(None).cast("double")
    return df.select(at.alias("open_time"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")], F.coalesce(volume, F.lit(float("nan"))).alias("volume"))


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """A result as CSV with header, JSON lines or Parquet; writing it again replaces it."""
    if form not in ("csv", "json", "parquet"):
        raise ValueError(f"no such form: {form}")
    w = df.write.mode("overwrite")
    (w.option("header", True).option("escape", '"') if form == "csv" else w).format(form).save(path)
