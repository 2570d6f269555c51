"""Forward-return labels with strictly later entries, and labelled opinions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import TIMEFRAME_SECONDS
from .asof import asof_forward_strict


def seconds(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


def simple_label(bars: DataFrame, by: list[str], horizon: int) -> DataFrame:
    """ln(close ``horizon`` bars on / next open), null past the end."""
    w = Window.partitionBy(*by).orderBy("open_time")
    return bars.withColumn("label", F.ln(F.lead("close", horizon).over(w) / F.lead("open", 1).over(w)))


def horizon_label(bars: DataFrame, by: list[str], horizon: int, max_step_seconds: int) -> DataFrame:
    """Entry at the first open strictly after a bar's close, exit ``horizon`` bars later.

    Null if a step between entry and exit is longer than allowed or the exit lies past the end;
    how far the entry is from the bar does not matter. Gaps are counted once in a running sum;
    equal sums mean no gap in between.
    """
    w = Window.partitionBy(*by).orderBy("open_time")
    long = (seconds("open_time") - F.lag(seconds("open_time")).over(w)) > max_step_seconds
    b = bars.withColumn("__rn", F.row_number().over(w)).withColumn("__long", F.coalesce(long, F.lit(False)).cast("int"))
    b = b.withColumn("__gaps", F.sum("__long").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    entry = b.select(*by, F.col("open_time").alias("entry_at"), F.col("open").alias("__entry"), F.col("__rn").alias("__entry_rn"), F.col("__gaps").alias("__entry_gaps"))
    with_entry = asof_forward_strict(b, entry, by, "close_time", "entry_at", ["entry_at", "__entry", "__entry_rn", "__entry_gaps"], ["entry_at"])
    leave = b.select(*[F.col(k).alias(f"__x_{k}") for k in by], F.col("__rn").alias("__exit_rn"), F.col("close").alias("__exit"), F.col("__gaps").alias("__exit_gaps"))
    on = [F.col(k) == F.col(f"__x_{k}") for k in by] + [F.col("__entry_rn") + horizon - 1 == F.col("__exit_rn")]
    out = with_entry.join(leave, on, "left")
    label = F.when(F.col("__exit_gaps") == F.col("__entry_gaps"), F.ln(F.col("__exit") / F.col("__entry")))
    return out.withColumn("label", label).select(*bars.columns, "entry_at", "label")


def opinion_labels(opinions: DataFrame, bars: DataFrame, max_lag: int = 2, grid: tuple[str, ...] = ("1h", "4h", "1d")) -> DataFrame:
    """One row per opinion and horizon: status, entry, exit, log return, stance direction and hit.

    Opinions without a horizon are judged on the grid. ``bars`` has all timeframes; entry is the
    first bar of the horizon's timeframe that opens strictly after the opinion. The first status
    that applies wins; a flat opinion hits only on a return of exactly zero.
    """
    length = F.element_at(F.create_map(*[F.lit(x) for kv in TIMEFRAME_SECONDS.items() for x in kv]), F.col("timeframe"))
    o = opinions.withColumn("horizon_source", F.when(F.col("horizon").isNull(), "grid").otherwise("stated"))
    o = o.withColumn("timeframe", F.explode(F.when(F.col("horizon").isNull(), F.array(*[F.lit(g) for g in grid])).otherwise(F.array("horizon"))))
    o = o.withColumn("__key", F.coalesce("instrument", F.lit(""))).withColumn("effective_at", F.col("effective_at").cast("timestamp"))
    b = bars.select(F.col("instrument").alias("__key"), "timeframe", F.col("open_time").alias("entry_at"), F.col("close_time").alias("exit_at"),
                    F.col("open").alias("entry"), F.col("close").alias("exit"))
    got = asof_forward_strict(o, b, ["__key", "timeframe"], "effective_at", "entry_at", ["entry_at", "exit_at", "entry", "exit"], ["entry_at"])
    got = got.withColumn("__len", length)
    stance = F.when(F.col("stance") == "LONG", 1).when(F.col("stance") == "SHORT", -1).when(F.col("stance") == "FLAT", 0)
    status = (F.when(~F.col("trusted"), "UNTRUSTED_COLLECTION_TIME").when(F.col("__len").isNull(), "MISSING_HORIZON")
              .when(F.col("instrument").isNull(), "MISSING_INSTRUMENT").when(stance.isNull(), "UNKNOWN_STANCE")
              .when(F.col("entry_at").isNull(), "NO_ENTRY_BAR")
              .when(seconds("entry_at") - seconds("effective_at") > max_lag * F.col("__len"), "ENTRY_LAG_EXCEEDED")
              .when(seconds("exit_at") - seconds("entry_at") != F.col("__len"), "GAP_IN_HORIZON").otherwise("LABELED"))
    got = got.withColumn("status", status)
    ok = F.col("status") == "LABELED"
    ret = F.when(ok, F.ln(F.col("exit") / F.col("entry")))
    return got.select(*[c for c in opinions.columns if c != "horizon"], F.col("timeframe").alias("horizon"), "horizon_source", "status",
                      F.when(ok, F.col("entry_at")).alias("entry_at"), F.when(ok, F.col("exit_at")).alias("exit_at"), ret.alias("log_return"),
                      F.when(ok, stance).alias("stance_direction"), F.when(ok, F.signum(ret) == stance).alias("direction_hit"))
