"""Indicators with memory: exponential means, RSI, MACD, ATR and ADX, per series and segment.

A series is cut into chunks of time, and a chunk is what a task works on. Exponential means are affine maps of the
value before, so all means of a stage are scanned together: a window gives each row's own part inside its chunk, the
chunks' maps are composed in order, one row a chunk, and each row adds what its chunk starts from. Where an
expression looks back some rows, the last rows of a chunk are copied to the next one.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a chunk: a thousand hourly bars.
CHUNK_SECONDS = 1000 * 3600
INDICATORS = ["ema_20", "ema_60", "ema_20_slope_4", "ema_60_slope_4", "atr_14_pct", "adx_14", "atr_pct_rank_60", "rsi_14", "macd_hist"]


class Mean(NamedTuple):
    """An exponential mean of a column: null until ``warm`` values were seen; it starts with the first value."""

    value: Column
    alpha: float
    warm: int = 1


def chunk_of(at: str, seconds: int = CHUNK_SECONDS) -> Column:
    return F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds)


def ewm_scan(df: DataFrame, by: list[str], order: str, means: dict[str, Mean], chunk: str = "__chunk") -> DataFrame:
    """Adds the means, all in one scan over the chunks of each series.

    Where a value is null the mean stays what it was. Only a row a chunk of a series meet in one place. A chunk
    should hold some thousand rows at most, as powers of 1 - alpha over a chunk must be doubles.
    """
    w = Window.partitionBy(*by, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    names, got = list(means), lambda k, name: F.col(f"__{k}_{name}")
    d = df.withColumns({f"__x_{name}": m.value.cast("double") for name, m in means.items()})
    d = d.withColumns({f"__n_{name}": F.count(f"__x_{name}").over(w) for name in names})
    d = d.withColumns({f"__p_{name}": F.pow(F.lit(1.0 - m.alpha), got("n", name)) for name, m in means.items()})
    sums = {}
    for name, m in means.items():  # two sums: as if the series began before the chunk, and as if it began in it
        later = m.alpha * got("x", name) / got("p", name)
        begun = F.when(got("n", name) == 1, got("x", name) / got("p", name)).otherwise(later)
        sums |= {f"__{k}_{name}": got("p", name) * F.coalesce(F.sum(v).over(w), F.lit(0.0)) for k, v in (("a", later), ("b", begun))}
    d = d.withColumns(sums)
    ends = d.groupBy(*by, chunk).agg(F.max_by(F.array(*[F.struct(
        *[F.col(f"__{k}_{name}").alias(k) for k in "npab"]) for name in names]), order).alias("e"))
    zero = ", ".join(["struct(0L as n, 0D as y)"] * len(names))
    starts = (ends.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(chunk).alias("c"), "e"))).alias("s"))
              .select(*by, F.explode(F.expr(f"""aggregate(s, struct(array({zero}) as now, cast(array() as array<struct<c: bigint, at: array<struct<n: bigint, y: double>>>>) as out),
                (t, r) -> struct(zip_with(t.now, r.e, (o, m) -> struct(o.n + m.n as n, CASE WHEN m.n = 0 THEN o.y WHEN o.n = 0 THEN m.b ELSE m.a + m.p * o.y END as y)) as now,
                                 array_append(t.out, struct(r.c as c, t.now as at)) as out), t -> t.out)""")).alias("o"))
              .select(*by, F.col("o.c").alias(chunk), F.col("o.at").alias("__at")))
    d = d.join(starts, [*by, chunk])
    out = {}
    for i, (name, m) in enumerate(means.items()):
        before = F.col("__at")[i]
        y = F.when(before.n == 0, got("b", name)).otherwise(got("a", name) + got("p", name) * before.y)
        out[name] = F.when(before.n + got("n", name) >= m.warm, y)
    d = d.withColumns(out)
    return d.drop("__at", *[f"__{k}_{name}" for name in names for k in "xnpab"])


def looking_back(df: DataFrame, by: list[str], order: str, rows: int, columns: dict[str, Column], chunk: str = "__chunk") -> DataFrame:
    """Adds columns over windows by (by, chunk) that look at most ``rows`` rows back.

    The last rows of each chunk stand before the next one while the columns are made. Two chunks that follow each
    other in a series must be next to each other in time, and none but a series' first may hold fewer rows.
    """
    last = F.row_number().over(Window.partitionBy(*by, chunk).orderBy(F.desc(order)))
    ranked = df.withColumn("__last", last)
    both = ranked.withColumn("__copy", F.lit(False)).unionByName(
        ranked.where(F.col("__last") <= rows).withColumn(chunk, F.col(chunk) + 1).withColumn("__copy", F.lit(True)))
    return both.withColumns(columns).where("not __copy").drop("__copy", "__last")


def ewm_mean(df: DataFrame, by: list[str], order: str, value: str, alpha: float, name: str, min_periods: int = 1, chunk_rows: int = 128,
             step_seconds: int = 3600) -> DataFrame:
    """One exponential mean of a column without nulls, in chunks of the time that ``chunk_rows`` rows take."""
    if alpha >= 1:  # nothing is remembered
        rows = F.row_number().over(Window.partitionBy(*by).orderBy(order)) if min_periods > 1 else F.lit(1)
        return df.withColumn(name, F.when(rows >= min_periods, F.col(value).cast("double")))
    # Powers of 1 - alpha inside a chunk stay within the range of doubles.
    rows = min(chunk_rows, max(1, int(60 / -math.log10(1.0 - alpha))))
    cut = df.withColumn("__chunk", chunk_of(order, rows * step_seconds))
    return ewm_scan(cut, by, order, {name: Mean(F.col(value), alpha, min_periods)}).drop("__chunk")


def rsi_column(gain: Column, loss: Column) -> Column:
    """100 without losses, 0 without gains, 50 without either."""
    return F.when((loss == 0) & (gain == 0), 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss))


def indicators(segmented: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Bars with their segment -> bars with indicators; nothing is carried from one segment to the next."""
    by, t = ["instrument", "segment"], "open_time"
    d = segmented.withColumn("__chunk", chunk_of(t, chunk_seconds))
    w = Window.partitionBy(*by, "__chunk").orderBy(t)
    high, low, close = (F.col(c).cast("double") for c in ("high", "low", "close"))
    was = {c: F.lag(F.col(c).cast("double")).over(w) for c in ("high", "low", "close")}
    up, down, step = high - was["high"], was["low"] - low, close - was["close"]
    d = looking_back(d, by, t, 1, {
        "__range": F.greatest(high - low, F.abs(high - was["close"]), F.abs(low - was["close"])),  # without nulls: the first bar has high - low
        "__plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "__minus": F.when((down > up) & (down > 0), down).otherwise(0.0),
        "__gain": F.greatest(step, step * 0), "__loss": F.greatest(-step, step * 0)})
    c, fourteen = F.col("close"), 1 / 14
    d = ewm_scan(d, by, t, {"ema_20": Mean(c, 2 / 21, 20), "ema_60": Mean(c, 2 / 61, 60), "__fast": Mean(c, 2 / 13, 12), "__slow": Mean(c, 2 / 27, 26),
                            **{f"__m{x}": Mean(F.col(f"__{x}"), fourteen, 14) for x in ("range", "plus", "minus", "gain", "loss")}})
    atr, both = F.col("__mrange"), F.col("__mplus") + F.col("__mminus")
    d = d.withColumns({"atr_14_pct": atr / close, "__macd": F.col("__fast") - F.col("__slow"), "rsi_14": rsi_column(F.col("__mgain"), F.col("__mloss")),
                       "__dx": F.when((both != 0) & (atr != 0), 100 * F.abs(F.col("__mplus") - F.col("__mminus")) / both)})
    sixty = F.collect_list("atr_14_pct").over(w.rowsBetween(-59, 0))
    slopes = {f"ema_{n}_slope_4": F.col(f"ema_{n}") / F.lag(f"ema_{n}", 4).over(w) - 1 for n in (20, 60)}
    d = looking_back(d, by, t, 59, {**slopes, "__sixty": sixty})
    rank = F.size(F.filter("__sixty", lambda x: x <= F.col("atr_14_pct"))) / 60
    d = d.withColumn("atr_pct_rank_60", F.when(F.size("__sixty") == 60, rank))
    d = ewm_scan(d, by, t, {"adx_14": Mean(F.col("__dx"), fourteen, 14), "__signal": Mean(F.col("__macd"), 2 / 10, 9)})
    d = d.withColumn("macd_hist", (F.col("__macd") - F.col("__signal")) / close)
    return d.select(*segmented.columns, *INDICATORS)
