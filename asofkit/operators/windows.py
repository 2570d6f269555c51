"""Row-window features over bars, runs of states, bins, splits and q-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def rows(w: WindowSpec, n: int, last: int = 0) -> WindowSpec:
    return w.rowsBetween(last - n + 1, last)


def full(value: Column, of: Column, w: WindowSpec, n: int) -> Column:
    """``value`` where the frame holds ``n`` values, else null."""
    return F.when(F.count(of).over(w) == n, value)


def return_features(bars: DataFrame, by: list[str], n: int = 20) -> DataFrame:
    """Log return, momentum, distance to the mean, volatility and breakout over the prior high."""
    w = Window.partitionBy(*by).orderBy("open_time")
    b = bars.withColumn("log_return", F.ln("close") - F.ln(F.lag("close").over(w)))
    r, c, long, prior = F.col("log_return"), F.col("close"), rows(w, n), rows(w, n, -1)
    return (b.withColumn("momentum", full(F.sum(r).over(long), r, long, n))
            .withColumn("mean_gap", full(c / F.avg(c).over(long) - 1, c, long, n))
            .withColumn("mean_gap_4", full(c / F.avg(c).over(rows(w, 4)) - 1, c, rows(w, 4), 4))
            .withColumn("volatility", full(F.stddev_samp(r).over(long), r, long, n))
            .withColumn("volatility_4", full(F.stddev_pop(r).over(rows(w, 4)), r, rows(w, 4), 4))
            .withColumn("breakout", full(c / F.max("high").over(prior) - 1, F.col("high"), prior, n)))


def state_runs(states: DataFrame, by: list[str], order: str, state: str) -> DataFrame:
    """Runs of equal neighbouring states: start, end, length."""
    w = Window.partitionBy(*by).orderBy(order)
    change = (~F.col(state).eqNullSafe(F.lag(state).over(w))) | F.lag(order).over(w).isNull()
    numbered = states.withColumn("__c", change.cast("int")).withColumn("__run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (numbered.groupBy(*by, "__run").agg(F.first(state).alias(state), F.min(order).alias("start_at"), F.max(order).alias("end_at"), F.count(F.lit(1)).alias("n"))
            .drop("__run"))


def longest_run(states: DataFrame, by: list[str], order: str, state: str) -> DataFrame:
    return state_runs(states, by, order, state).groupBy(*by, state).agg(F.max("n").alias("longest"))


def daily_switches(runs: DataFrame, by: list[str], state: str, unknown: str = "UNKNOWN") -> DataFrame:
    """Starts of known runs a day that follow another known run directly."""
    prev = F.lag(state).over(Window.partitionBy(*by).orderBy("start_at"))
    return (runs.withColumn("__p", prev).where(F.col("__p").isNotNull() & (F.col("__p") != unknown) & (F.col(state) != unknown))
            .groupBy(*by, F.to_date("start_at").alias("day")).agg(F.count(F.lit(1)).alias("switches")))


def failure_streak(runs: DataFrame, by: list[str], order: list[Column], failed: Column) -> DataFrame:
    """Failures in a row from the newest run backwards."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("__f", F.min(failed.cast("int")).over(w)).groupBy(*by).agg(F.sum("__f").alias("streak"))


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def first_occurrence(df: DataFrame, keys: list[str], order: list[Column], flag: str = "status") -> DataFrame:
    """ACCEPTED for the first row of a key in ``order``, DUPLICATE for later ones."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(flag, F.when(n == 1, "ACCEPTED").otherwise("DUPLICATE"))


def contiguous_window(bars: DataFrame, by: list[str], n: int, step_seconds: int) -> DataFrame:
    """Bars with ``window_ok``: the last ``n`` bars have the right length and touch each other."""
    w = Window.partitionBy(*by).orderBy("open_time")
    t = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    right = (t("close_time") - t("open_time") == step_seconds).cast("int")
    touch = (F.lag("close_time").over(w) == F.col("open_time")).cast("int")
    b = bars.withColumn("__r", right).withColumn("__t", F.coalesce(touch, F.lit(0)))
    return b.withColumn("window_ok", (F.sum("__r").over(rows(w, n)) == n) & (F.sum("__t").over(rows(w, n - 1)) == n - 1)).drop("__r", "__t")


def equal_frequency_bins(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "bin") -> DataFrame:
    """Bins 0..k-1 whose cuts are i * n / k, rounded half to even."""
    w = Window.partitionBy(*by)
    n, at = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*order)) - 1
    d = df.withColumn("__n", n).withColumn("__i", at)
    cut = lambda i: F.bround((F.col("__n") * i / F.lit(k)).cast("decimal(20,6)"), 0)
    bin_ = sum(((F.col("__i") >= cut(i)).cast("int") for i in range(1, k)), F.lit(0))
    return d.withColumn(name, bin_).drop("__n", "__i")


def time_split(df: DataFrame, by: list[str], order: list[Column], embargo: int, shares: tuple[float, float] = (0.6, 0.8),
               minimum: int = 500, strict: bool = True) -> DataFrame:
    """``part`` train, validation or test by row number; ``embargo`` rows after each border are left out.

    A series of fewer than ``minimum`` rows is an error, or without ``strict`` has no parts.
    """
    w = Window.partitionBy(*by)
    d = df.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1)
    a, b = F.floor(F.col("__n") * shares[0]), F.floor(F.col("__n") * shares[1])
    short = F.raise_error(F.format_string("a series has %d rows, of " + str(minimum), "__n")) if strict else F.lit(None).cast("string")
    part = (F.when(F.col("__n") < minimum, short).when(F.col("__i") < a, "train").when(F.col("__i") < a + embargo, "embargo")
            .when(F.col("__i") < b, "validation").when(F.col("__i") < b + embargo, "embargo").otherwise("test"))
    return d.withColumn("part", part).drop("__n", "__i")


def walk_forward(df: DataFrame, by: list[str], order: list[Column], train_ratio: float, window_rows: int, horizon: int,
                 min_train: int, min_window: int) -> DataFrame:
    """Rows from the first test row on: row, window, train_end and whether the window is ``used``.

    The first window starts at ``train_ratio`` of the rows. A window trains on all rows that end
    ``horizon`` rows before it, so that no label reaches into it; it is skipped if it or its
    training part is too short.
    """
    w = Window.partitionBy(*by)
    d = df.withColumn("row", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    d = d.withColumn("__first", F.floor(F.col("__n") * train_ratio)).where("row >= __first")
    d = d.withColumn("window", F.floor((F.col("row") - F.col("__first")) / window_rows))
    start = F.col("__first") + F.col("window") * window_rows
    d = d.withColumn("train_end", F.greatest(start - horizon, F.lit(0)))
    size = F.least(start + window_rows, F.col("__n")) - start
    return d.withColumn("used", (F.col("train_end") >= min_train) & (size >= min_window)).drop("__n", "__first")


def every_nth(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """Every n-th row from the first, so that horizons of n rows do not overlap."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("__i", i).where(F.col("__i") % n == 0).drop("__i")


def q_values(tests: DataFrame, family: list[str], p: str, tie: list[str]) -> DataFrame:
    """Benjamini-Hochberg q-values; a null p-value is no member of the family and has no q-value."""
    known = tests.where(F.col(p).isNotNull())
    w = Window.partitionBy(*family)
    ranked = known.withColumn("__r", F.row_number().over(w.orderBy(p, *tie))).withColumn("__m", F.count(F.lit(1)).over(w))
    q = F.min(F.col(p) * F.col("__m") / F.col("__r")).over(w.orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.withColumn("q", F.least(q, F.lit(1.0))).drop("__r", "__m")
    return out.unionByName(tests.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))
