"""What was visible at a time: windows of bars, frozen feature snapshots and their replay, derived bars, macro frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof, bars as bar_ops, store, windows

FEATURES = ["close", "log_return_1", "momentum_4", "sma_4_ratio", "realized_vol_4", "range_pct"]
WINDOW = 5


def visible(bars: DataFrame, as_of: Column) -> DataFrame:
    """Bars that were closed and known at ``as_of``."""
    return bars.where((F.col("close_time") <= as_of) & (F.col("effective_at") <= as_of))


def window_features(bars: DataFrame, by: list[str], step_seconds: int) -> DataFrame:
    """Every bar with ``window_ok`` and six features of the five touching bars that end with it, else null.

    ``input_ids`` are the ids of the five and ``known_at`` is when the last of them became known.
    """
    order = Window.partitionBy(*by).orderBy("open_time")
    b = windows.contiguous_window(bars, by, WINDOW, step_seconds).withColumn("__r", F.ln(F.col("close") / F.lag("close").over(order)))
    last = lambda n: order.rowsBetween(1 - n, 0)
    values = {
        "close": F.col("close").cast("double"), "log_return_1": F.col("__r"), "momentum_4": F.ln(F.col("close") / F.lag("close", WINDOW - 1).over(order)),
        "sma_4_ratio": F.col("close") / F.avg("close").over(last(4)) - 1, "realized_vol_4": F.stddev_pop("__r").over(last(4)), "range_pct": (F.col("high") - F.col("low")) / F.col("close")}
    ok = F.coalesce("window_ok", F.lit(False))
    return b.select(*by, "open_time", "close_time", ok.alias("window_ok"), F.when(ok, F.collect_list("bar_id").over(last(WINDOW))).alias("input_ids"),
                    F.when(ok, F.max("effective_at").over(last(WINDOW))).alias("known_at"), *[F.when(ok, F.round(v, 10)).alias(f"f_{k}") for k, v in values.items()])


def latest_features(bars: DataFrame, by: list[str], as_of: Column, step_seconds: int, newest: int = 512) -> DataFrame:
    """The newest whole window of each key among its ``newest`` visible bars; a key without one is left out."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("close_time").desc()))
    seen = visible(bars, as_of).withColumn("__n", n).where(F.col("__n") <= newest).drop("__n")
    return windows.latest(window_features(seen, by, step_seconds).where("window_ok"), by, [F.col("close_time").desc()]).withColumn("as_of", as_of)


def freeze(features: DataFrame, bars: DataFrame, by: list[str]) -> DataFrame:
    """Feature rows with ``data_hash``, the digest of the bars they were made of."""
    return features.join(_hashes(features, bars, by), [*by, "as_of"])


def _hashes(snapshots: DataFrame, bars: DataFrame, by: list[str]) -> DataFrame:
    ids = snapshots.select(*by, "as_of", F.posexplode("input_ids").alias("pos", "bar_id"))
    token = store.row_digest([c for c in bars.columns if c not in by])
    rows = ids.join(bars.withColumn("__d", token).select("bar_id", "__d"), "bar_id")
    return rows.groupBy(*by, "as_of").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "__d"))), lambda x: x["__d"]), "|"), 256).alias("data_hash"))


def replay(snapshots: DataFrame, bars: DataFrame, by: list[str], step_seconds: int) -> DataFrame:
    """Each snapshot recomputed from its frozen bars alone: ``problem`` is null, or what differs."""
    ids = snapshots.select(*by, "as_of", F.explode("input_ids").alias("bar_id"))
    rows = ids.join(bars.drop(*by), "bar_id")
    key = [*by, "as_of"]
    again = windows.latest(window_features(rows, key, step_seconds), key, [F.col("close_time").desc()])
    late = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.max(F.greatest("close_time", "effective_at")).alias("__last"))
    new = again.select(*key, F.col("window_ok").alias("__ok"), *[F.col(f"f_{k}").alias(f"n_{k}") for k in FEATURES]).join(late, key).join(
        _hashes(snapshots, bars, by).withColumnRenamed("data_hash", "__hash"), key)
    same = F.lit(True)
    for k in FEATURES:
        same &= F.col(f"f_{k}").eqNullSafe(F.col(f"n_{k}"))
    problem = (F.when(F.coalesce("__n", F.lit(0)) != WINDOW, "inputs_missing").when(~F.col("__ok"), "not_contiguous").when(F.col("__last") > F.col("as_of"), "not_visible")
               .when(~F.col("data_hash").eqNullSafe(F.col("__hash")), "inputs_changed").when(~same, "values_differ"))
    return snapshots.join(new, key, "left").withColumn("problem", problem).select(*snapshots.columns, "problem")


def derived_bars(base: DataFrame, existing: DataFrame, step_seconds: int, bucket_seconds: int, computed_at: Column) -> DataFrame:
    """Complete larger bars that ``existing`` (instrument, open_time) lacks, usable once closed and computed."""
    made, _ = bar_ops.complete_bars(base, step_seconds, bucket_seconds)
    new = made.join(existing.select("instrument", "open_time"), ["instrument", "open_time"], "left_anti")
    return new.withColumn("close_time", F.timestamp_seconds(F.unix_seconds(F.col("open_time").cast("timestamp")) + bucket_seconds)).withColumn(
        "effective_at", F.greatest("close_time", computed_at))


def new_versions(data: DataFrame, versions: DataFrame, name: str) -> DataFrame:
    """(dataset, rows, digest) of a table, if ``versions`` does not hold that digest yet."""
    return store.table_digest(data).select(F.lit(name).alias("dataset"), "rows", "digest").join(versions.select("dataset", "digest"), ["dataset", "digest"], "left_anti")


def append_derived(base: DataFrame, path: str, versions_path: str, name: str, step_seconds: int, bucket_seconds: int, computed_at: Column) -> None:
    """Appends the larger bars that the table at ``path`` lacks, and notes the table's digest where it is a new one.

    Running it again on the same bars adds neither bars nor a version; bars that are there keep their effective time.
    """
    spark = base.sparkSession

    def there(at: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(at)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], schema)

    derived_bars(base, there(path, "instrument string, open_time timestamp"), step_seconds, bucket_seconds, computed_at).write.mode("append").parquet(path)
    versions = there(versions_path, "dataset string, rows bigint, digest string")
    new_versions(spark.read.parquet(path), versions, name).write.mode("append").parquet(versions_path)


def macro_frame(bars: DataFrame, releases: DataFrame, codes: list[str], other: DataFrame, chunk: str = "month") -> DataFrame:
    """Bars with level, change and release time of each code by its release, and features of a second series.

    Nothing is aligned by observation date: a value counts from its release on, the second series
    (close_time, close) from its close on. ``future_return`` is that of the first bar after the close.
    """
    code = Window.partitionBy("event_code").orderBy("released_at", "release_id")
    r = releases.withColumn("change", F.col("actual_value") - F.lag("actual_value").over(code))
    out = bars.withColumn("signal_at", F.col("close_time").cast("timestamp"))
    for c in codes:
        one = r.where(F.col("event_code") == c).select(F.lit(1).alias("__one"), F.col("released_at").cast("timestamp").alias(f"{c}_released_at"), F.col("actual_value").alias(f"{c}_level"),
                                                       F.col("change").alias(f"{c}_change"), F.col("release_id").alias("__id"))
        out = asof.asof_backward(out.withColumn("__one", F.lit(1)), one, ["__one"], "signal_at", f"{c}_released_at",
                                 [f"{c}_released_at", f"{c}_level", f"{c}_change", "__id"], ["__id"], chunk).drop("__id", "__one")
    every = Window.orderBy("close_time").partitionBy(F.lit(1))
    lr = F.ln(F.col("close") / F.lag("close").over(every))
    o = other.select(F.lit(1).alias("__one"), F.col("close_time").cast("timestamp").alias("other_at"), "close", "close_time").withColumn("other_ret_1", lr)
    long = every.rowsBetween(-19, 0)
    o = o.withColumn("other_momentum_20", F.when(F.count("other_ret_1").over(long) == 20, F.sum("other_ret_1").over(long)))
    out = asof.asof_backward(out.withColumn("__one", F.lit(1)), o, ["__one"], "signal_at", "other_at", ["other_at", "other_ret_1", "other_momentum_20"], ["other_at"], chunk).drop("__one")
    entry = bars.select("instrument", F.col("open_time").cast("timestamp").alias("__entry_at"), F.ln(F.col("close") / F.col("open")).alias("future_return"))
    return asof.asof_forward_strict(out, entry, ["instrument"], "signal_at", "__entry_at", ["__entry_at", "future_return"], ["__entry_at"], chunk).drop("__entry_at")


def time_violations(frame: DataFrame, released: list[str], at: str) -> DataFrame:
    """(column, violations): joined values that were released after the time they are used at."""
    counts = frame.agg(*[F.count_if(F.col(c) > F.col(at)).alias(c) for c in released])
    return counts.unpivot([], released, "column", "violations")
