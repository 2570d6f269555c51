"""Bars: validity, complete buckets, sessions, gaps and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OHLC = ["open", "high", "low", "close"]


def reasons(**rules: Column) -> Column:
    """Array of the names of the rules that hold; a null rule does not hold."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules.items()]))


def bar_problems() -> Column:
    o, h, l, c = (F.col(x) for x in OHLC)  # noqa: E741
    return reasons(
        missing_time=F.col("open_time").isNull() | F.col("close_time").isNull(),
        time_order=F.col("close_time") <= F.col("open_time"),
        missing_price=o.isNull() | h.isNull() | l.isNull() | c.isNull(),
        high_bound=h < F.greatest(o, c, l),
        low_bound=l > F.least(o, c, h),
        price_not_positive=F.least(o, h, l, c) <= 0,
        negative_volume=F.col("volume") < 0)


def _bucket(seconds: int) -> Column:
    t = F.unix_seconds(F.col("open_time").cast("timestamp"))
    return F.timestamp_seconds(t - F.pmod(t, F.lit(seconds)))


def complete_bars(bars: DataFrame, base_seconds: int, bucket_seconds: int, need_volume: bool = False) -> tuple[DataFrame, DataFrame]:
    """(full, skipped) buckets. A bucket is full with all its base bars, each at its own time.

    Volume is null if it is null in all base bars; with ``need_volume`` it must be positive.
    """
    if bucket_seconds % base_seconds or 86400 % bucket_seconds:
        raise ValueError("a bucket must hold whole base bars and divide a day")
    need = bucket_seconds // base_seconds
    grouped = (bars.withColumn("bucket", _bucket(bucket_seconds)).groupBy("instrument", "bucket")
               .agg(F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                    F.max_by("close", "open_time").alias("close"), F.sum("volume").alias("volume"),
                    F.count(F.lit(1)).alias("n"), F.count_distinct("open_time").alias("n_times")))
    full = (F.col("n") == need) & (F.col("n_times") == need)
    if need_volume:
        full &= F.coalesce(F.col("volume"), F.lit(0)) > 0
    made = grouped.where(full).drop("n", "n_times").withColumnRenamed("bucket", "open_time")
    return made, grouped.where(~full).select("instrument", F.col("bucket").alias("open_time"), "n")


def session_profile(slots: DataFrame, tz: str, threshold: float) -> DataFrame:
    """Share of slots with prices by local weekday and hour; below ``threshold`` the market is closed."""
    local = F.from_utc_timestamp(F.col("open_time").cast("timestamp"), tz)
    return (slots.groupBy("instrument", F.weekday(local).alias("weekday"), F.hour(local).alias("hour"))
            .agg(F.avg(F.col("open").isNotNull().cast("double")).alias("presence"), F.count(F.lit(1)).alias("n"))
            .withColumn("closed", F.col("presence") < threshold))


def usual_daily_slots(slots: DataFrame, tz: str) -> DataFrame:
    """Most frequent number of slots a day by weekday; of equal ones that which came first."""
    local = F.from_utc_timestamp(F.col("open_time").cast("timestamp"), tz)
    daily = slots.groupBy("instrument", F.to_date(local).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    freq = daily.groupBy("instrument", F.weekday("day").alias("weekday"), "n").agg(F.count(F.lit(1)).alias("days"), F.min("day").alias("since"))
    best = Window.partitionBy("instrument", "weekday").orderBy(F.col("days").desc(), "since")
    return freq.withColumn("r", F.row_number().over(best)).where("r = 1").select("instrument", "weekday", F.col("n").alias("usual"))


def gap_audit(slots: DataFrame, tz: str = "America/New_York", threshold: float = 0.5, holiday_share: float = 0.8) -> DataFrame:
    """Slots without prices by cause, and times that are missing altogether.

    A null slot in a closed hour is a session break; on a day whose open hours are mostly null it
    may be a holiday; else it is a data gap. Missing slots are those short of the weekday's usual
    number.
    """
    local = F.from_utc_timestamp(F.col("open_time").cast("timestamp"), tz)
    profile = session_profile(slots, tz, threshold).select("instrument", "weekday", "hour", "closed")
    s = (slots.withColumn("day", F.to_date(local)).withColumn("weekday", F.weekday(local)).withColumn("hour", F.hour(local))
         .join(profile, ["instrument", "weekday", "hour"]))
    by_day = s.groupBy("instrument", "day").agg(
        F.coalesce(F.avg(F.when(~F.col("closed"), F.col("open").isNull().cast("double"))), F.lit(0.0)).alias("null_share"))
    marked = s.join(by_day, ["instrument", "day"]).withColumn(
        "category", F.when(F.col("open").isNotNull(), "ok").when(F.col("closed"), "session_break")
        .when(F.col("null_share") >= holiday_share, "holiday_suspect").otherwise("data_gap"))
    counts = marked.groupBy("instrument", "category").agg(F.count(F.lit(1)).alias("n"))
    daily = s.groupBy("instrument", "day", F.weekday("day").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    short = (daily.join(usual_daily_slots(slots, tz), ["instrument", "weekday"])
             .groupBy("instrument").agg(F.sum(F.greatest(F.col("usual") - F.col("n"), F.lit(0))).alias("n"))
             .select("instrument", F.lit("missing").alias("category"), "n"))
    return counts.unionByName(short)


def low_coverage_days(slots: DataFrame, tz: str, k: int = 10) -> DataFrame:
    """The ``k`` days of each instrument with the largest deficit against the usual number of slots."""
    local = F.from_utc_timestamp(F.col("open_time").cast("timestamp"), tz)
    daily = slots.groupBy("instrument", F.to_date(local).alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("weekday", F.weekday("day"))
    short = daily.join(usual_daily_slots(slots, tz), ["instrument", "weekday"]).withColumn("deficit", F.col("usual") - F.col("n")).where("deficit > 0")
    rank = F.row_number().over(Window.partitionBy("instrument").orderBy(F.col("deficit").desc(), "day"))
    return short.withColumn("r", rank).where(F.col("r") <= k).select("instrument", "day", "n", "usual", "deficit")


def missing_times(bars: DataFrame, step_seconds: int, cap: int = 100) -> DataFrame:
    """Bar times that lie between neighbours, at most ``cap`` a gap."""
    follow = F.lead("open_time").over(Window.partitionBy("instrument").orderBy("open_time"))
    t = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    gaps = bars.select("instrument", "open_time", follow.alias("after")).where(t("after") - t("open_time") > step_seconds)
    n = F.least(F.floor((t("after") - t("open_time") - 1) / step_seconds), F.lit(cap))
    return gaps.select("instrument", F.explode(F.sequence(F.lit(1), n)).alias("i"), "open_time").select(
        "instrument", F.timestamp_seconds(t("open_time") + F.col("i") * step_seconds).alias("missing_time"))


def good_fridays(first_year: int, last_year: int) -> list[str]:
    """Two days before Easter Sunday, by Gauss's rule in its form for all Gregorian years."""
    from datetime import date, timedelta

    out = []
    for y in range(first_year, last_year + 1):
        century, golden = y // 100, y % 19
        moon = (15 + century - century // 4 - (8 * century + 13) // 25 + 19 * golden) % 30  # days from 21 March to the full moon
        moon -= moon == 29 or moon == 28 and golden > 10
        full = date(y, 3, 21) + timedelta(moon)
        out.append((full + timedelta(6 - full.weekday() or 7) - timedelta(2)).isoformat())  # the Sunday after it
    return out


def market_closed(t: Column, first_year: int = 2015, last_year: int = 2035) -> Column:
    """Whether the hour that starts at UTC time ``t`` is closed by schedule.

    Closed from Friday 17:00 to Sunday 18:00 New York time, 17:00 to 18:00 every day, and in the
    hours that US holidays take: around Good Friday, Christmas and New Year whole days or evenings,
    on the others from the early close to the evening's opening. Good Friday is known for the years given.
    """
    ny = F.from_utc_timestamp(t.cast("timestamp"), "America/New_York")
    day, hour, month, dom = F.weekday(ny), F.hour(ny), F.month(ny), F.dayofmonth(ny)  # Monday is 0
    weekend = (day == 5) | ((day == 4) & (hour >= 17)) | ((day == 6) & (hour < 18))
    fridays = good_fridays(first_year, last_year)
    good = F.date_format(ny, "yyyy-MM-dd").isin(fridays) | (F.date_format(F.date_add(ny, 1), "yyyy-MM-dd").isin(fridays) & (hour >= 17))
    turn = (((month == 12) & (dom == 24) & (hour >= 14)) | ((month == 12) & (dom == 25) & (hour < 18))
            | ((month == 12) & (dom == 31) & (hour >= 17)) | ((month == 1) & (dom == 1) & (hour < 18)))
    early = (hour >= 15) & (hour < 18)
    monday = (day == 0) & (month.isin(1, 2) & dom.between(15, 21) | (month == 5) & (dom >= 25) | (month == 9) & (dom <= 7))
    moved = lambda m, d: (month == m) & ((dom == d) & (day < 5) | (dom == d - 1) & (day == 4) | (dom == d + 1) & (day == 0))
    summer = (moved(6, 19) | moved(7, 4)) & F.when(day == 4, hour >= 13).otherwise(early)
    thanks = (month == 11) & ((day == 3) & dom.between(22, 28) & early | (day == 4) & dom.between(23, 29) & (hour >= 15))
    return weekend | (hour == 17) | good | turn | (monday & early) | summer | thanks


def segments(bars: DataFrame, step_seconds: int = 3600) -> DataFrame:
    """Bars with ``segment``: it grows by one at each gap that the schedule does not explain."""
    order = Window.partitionBy("instrument").orderBy("open_time")
    t = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    b = bars.withColumn("__prev", F.lag("close_time").over(order))
    hours = F.expr(f"transform(sequence(unix_seconds(cast(__prev as timestamp)), unix_seconds(cast(open_time as timestamp)) - {step_seconds}, {step_seconds}L), x -> timestamp_seconds(x))")
    gap = F.col("__prev").isNotNull() & (t("open_time") > t("__prev"))
    unexpected = F.when(gap, ~F.forall(hours, lambda h: market_closed(h))).otherwise(F.col("__prev").isNotNull() & (t("open_time") < t("__prev")))
    return (b.withColumn("__cut", F.coalesce(unexpected, F.lit(False)).cast("int"))
            .withColumn("segment", F.sum("__cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__prev", "__cut"))
