"""Author skill and statistics of signals."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .windows import equal_frequency_bins

READY = 30


def visible_samples(samples: DataFrame, as_of: Column) -> DataFrame:
    """Samples that are effective by ``as_of``, the boundary included."""
    return samples.where(F.col("effective_at") <= as_of)


def label_samples(labels: DataFrame) -> DataFrame:
    """Labelled opinions with a direction as skill samples."""
    return labels.where("status = 'LABELED' and stance_direction is not null").select(
        "opinion_id", "author_id", "effective_at", "stance_direction", "direction_hit", "log_return", "confidence")


def direction_skill() -> list[Column]:
    hits, n = F.count_if("direction_hit"), F.count(F.lit(1))
    return [hits.alias("hits"), n.alias("trials"), (hits / n).alias("raw"), ((hits + 1) / (n + 2)).alias("posterior")]


def timing_skill(basis: float = 0.001, least: int = READY) -> list[Column]:
    """Mean directed return of hits and share of hits above ``basis``; null below ``least`` hits."""
    gain = F.when(F.col("direction_hit"), F.col("log_return") * F.col("stance_direction"))
    enough = F.count(gain) >= least
    return [F.when(enough, F.avg(gain)).alias("mean_gain"), F.when(enough, F.avg((gain > basis).cast("double"))).alias("share_above")]


def calibration(samples: DataFrame, k: int = 5, least: int = 10) -> DataFrame:
    """1 - expected calibration error over equal-frequency bins; null below ``least`` samples."""
    known = samples.where("confidence is not null")
    b = equal_frequency_bins(known, ["author_id"], [F.col("confidence"), F.col("effective_at"), F.col("opinion_id")], k)
    per = b.groupBy("author_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("direction_hit").cast("double")).alias("h"))
    total = per.groupBy("author_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.abs(F.col("c") - F.col("h"))).alias("e"))
    return total.select("author_id", F.when(F.col("n") >= least, 1 - F.col("e") / F.col("n")).alias("calibration"))


def author_skill(samples: DataFrame, as_of: Column) -> DataFrame:
    """Snapshot per author of what was known at ``as_of``; scores that cannot be given are null."""
    s = visible_samples(samples, as_of)
    base = s.groupBy("author_id").agg(*direction_skill(), *timing_skill())
    none = F.lit(None).cast("double")
    return (base.join(calibration(s), "author_id", "left").withColumn("ready", F.col("trials") >= READY)
            .withColumn("entry_skill", none).withColumn("exit_skill", none).withColumn("independence", none))


def average_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*by)
    ties = F.count(F.lit(1)).over(w.partitionBy(*by, value))
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (ties - 1) / 2)


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    """Rank correlation with average ranks; null if few rows or one side is constant."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(known, by, x, "__rx"), by, y, "__ry")
    g = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("__rx", "__ry").alias("c"), F.var_pop("__rx").alias("vx"), F.var_pop("__ry").alias("vy"))
    ok = (F.col("n") >= least) & (F.col("vx") > 0) & (F.col("vy") > 0)
    return g.select(*by, "n", F.when(ok, F.col("c") / F.sqrt(F.when(ok, F.col("vx") * F.col("vy")))).alias("ic"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p = hits / F.nullif(n, F.lit(0))
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z / d * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return mid - half, mid + half


def _stirling_error(k: Column) -> Column:
    """ln k! less Stirling's formula: by table up to 15, beyond that by its series, which then holds to the last digit."""
    table = [math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 16)]
    square = k * k
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * square)) / square) / square) / k
    return F.when(k > 15, series).otherwise(F.get(F.array(*map(F.lit, table)), k.cast("int") - 1))


def _half_pmf(k: Column, n: Column) -> Column:
    """Probability of exactly k of n fair draws, 0 < k < n, without differences of large logarithms."""
    u = (2 * k - n) / n
    v = u * u
    near = F.lit(0.0)
    for j in range(12, 0, -1):
        near = (near + 1 / (j * (2 * j - 1))) * v
    far = (1 + u) * F.log1p(u) + (1 - u) * F.log1p(-u)
    deviance = n / 2 * F.when(F.abs(u) < 0.2, near).otherwise(far)
    return F.sqrt(n / (2 * math.pi * k * (n - k))) * F.exp(_stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - deviance)


def binomial_p(hits: Column | str, n: Column | str) -> Column:
    """One-sided exact P(X >= hits) for n fair draws; null without draws.

    From the greater side of the middle the terms of the tail follow from the first one by their ratios, and after
    some multiples of sqrt(n) they no longer count, so a row costs about 5 sqrt(n) steps; the other side is the complement.
    """
    h, m = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (hits, n))
    k = F.greatest(h, m - h + 1)  # at or above the middle
    steps = F.least(m - k, F.ceil(5 * F.sqrt(m)) + 40).cast("int")
    ratios = F.aggregate(F.sequence(F.lit(0), F.greatest(steps, F.lit(0))), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
                         lambda acc, i: F.struct((acc.t * (m - k - i) / (k + i + 1)).alias("t"), (acc.s + acc.t).alias("s")), lambda acc: acc.s)
    first = F.when(k >= m, F.pow(F.lit(0.5), m)).otherwise(_half_pmf(k, m))
    tail = F.when(k > m, F.lit(0.0)).otherwise(first * ratios)
    return F.when(m > 0, F.when(h <= 0, F.lit(1.0)).when(h > m, F.lit(0.0)).when(h >= m - h + 1, F.least(tail, F.lit(1.0))).otherwise(1 - tail))


@F.pandas_udf(DoubleType())
def two_sided_normal_p(t: pd.Series) -> pd.Series:
    return t.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)))


def window_ic(df: DataFrame, by: list[str], window: str, x: str, y: str, least_windows: int = 3) -> DataFrame:
    """Rank correlation per window, and over windows its mean, deviation, ratio and share above 0.

    Windows without a value are left out; with fewer than ``least_windows`` the series is
    NOT_EVALUATED and its values are null, which is not 0.
    """
    per = spearman(df, [*by, window], x, y).where("ic is not null")
    g = per.groupBy(*by).agg(F.count(F.lit(1)).alias("windows"), F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"), F.avg((F.col("ic") > 0).cast("double")).alias("pos"))
    all_ = df.select(*by).distinct().join(g, by, "left").withColumn("windows", F.coalesce("windows", F.lit(0)))
    ok = F.col("windows") >= least_windows
    ir = F.when(ok & (F.col("s") > 0), F.col("m") / F.nullif(F.col("s"), F.lit(0.0)))
    return all_.select(*by, "windows", F.when(ok, F.col("m")).alias("ic_mean"), F.when(ok, F.col("s")).alias("ic_std"), ir.alias("icir"),
                       F.when(ok, F.col("pos")).alias("positive_ratio"), (ir * F.sqrt("windows")).alias("t"), F.when(ok, "EVALUATED").otherwise("NOT_EVALUATED").alias("scoring"))


def brier(p: Column, hit: Column) -> Column:
    return F.avg((p - hit.cast("double")) * (p - hit.cast("double")))


def reliability(df: DataFrame, by: list[str], p: str, hit: str, k: int = 10) -> DataFrame:
    bin_ = F.least(F.floor(F.col(p) * k), F.lit(k - 1))
    return df.groupBy(*by, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(hit).cast("double")).alias("hit_rate"))


def signal_metrics(df: DataFrame, by: list[str], p: str, hit: str, signal: str, ret: str) -> DataFrame:
    """Hit rate with Wilson interval and exact p-value, Brier score and rank correlation of a signal."""
    g = df.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count(hit).alias("n"), brier(F.col(p), F.col(hit)).alias("brier"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    g = g.withColumn("hit_rate", F.col("hits") / F.nullif(F.col("n"), F.lit(0))).withColumn("wilson_low", lo).withColumn("wilson_high", hi)
    return g.withColumn("p_value", binomial_p("hits", "n")).join(spearman(df, by, signal, ret).select(*by, "ic"), by, "left")


def signal_gate(metrics: DataFrame) -> DataFrame:
    good = ((F.col("ic") >= 0.03) & (F.col("icir") >= 0.3)) | ((F.col("hit_rate") > 0.5) & (F.col("p_value") < 0.05))
    return metrics.withColumn("gate", F.when(F.coalesce(good, F.lit(False)), "PASS").otherwise("FAIL"))


def random_baseline(key: Column, seed: int) -> Column:
    """A repeatable uniform number of a row."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_003)) / 1_000_003.0
