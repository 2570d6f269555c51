"""Market regimes: rules over indicators and event counts, smoothing, metrics and the hash chain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.hysteresis import Automaton
from ..shared import cut
from . import asof, bars, windows
from .indicators import CHUNK_SECONDS, chunk_of, indicators

NEEDED = ["ema_20", "ema_60", "ema_20_slope_4", "ema_60_slope_4", "adx_14", "atr_14_pct", "atr_pct_rank_60"]
NEWS_AT_LEAST, MACRO_AT_LEAST, SPAN_SECONDS = 3, 1, 4 * 3600


def _c(name: str) -> Column:
    return F.col(name)


def rule_regime() -> tuple[Column, Column]:
    """(regime, confidence): the first rule that applies."""
    missing = F.lit(False)
    for n in NEEDED:
        missing = missing | _c(n).isNull()
    news = (_c("n_news") >= NEWS_AT_LEAST) | (_c("n_macro") >= MACRO_AT_LEAST)
    rank, adx = _c("atr_pct_rank_60"), _c("adx_14")
    up = (adx >= 25) & (_c("ema_20") > _c("ema_60")) & (_c("ema_20_slope_4") > 0) & (_c("ema_60_slope_4") > 0)
    down = (adx >= 25) & (_c("ema_20") < _c("ema_60")) & (_c("ema_20_slope_4") < 0) & (_c("ema_60_slope_4") < 0)
    one = lambda c: F.least(F.lit(1.0), c)
    rules = [(missing, "UNKNOWN", F.lit(0.0)), (news, "NEWS_DRIVEN", one(0.7 + 0.1 * _c("n_news") + 0.2 * _c("n_macro"))),
             (rank >= 0.8, "HIGH_VOLATILITY", rank), (up, "TREND_UP", one(adx / 50)), (down, "TREND_DOWN", one(adx / 50)),
             (adx < 20, "RANGE", F.greatest(F.lit(0.5), 1 - adx / 40)), (rank <= 0.2, "LOW_VOLATILITY", 1 - rank)]
    regime, confidence = F.lit("RANGE"), F.lit(0.55)
    for cond, name, conf in reversed(rules):
        regime, confidence = F.when(cond, name).otherwise(regime), F.when(cond, conf).otherwise(confidence)
    return regime, confidence


def statistical_regime() -> Column:
    rank, adx = _c("atr_pct_rank_60"), _c("adx_14")
    trend = F.try_divide(_c("ema_20") - _c("ema_60"), _c("close") * _c("atr_14_pct"))
    return (F.when(rank.isNull(), "UNKNOWN").when((_c("n_news") >= NEWS_AT_LEAST) | (_c("n_macro") >= MACRO_AT_LEAST), "NEWS_DRIVEN")
            .when(rank >= 0.8, "HIGH_VOLATILITY").when((adx >= 22) & (trend >= 0.5) & (_c("ema_20_slope_4") > 0), "TREND_UP")
            .when((adx >= 22) & (trend <= -0.5) & (_c("ema_20_slope_4") < 0), "TREND_DOWN").when(adx < 20, "RANGE")
            .when(rank <= 0.2, "LOW_VOLATILITY").otherwise("RANGE"))


REGIMES = ["TREND_UP", "TREND_DOWN", "RANGE", "HIGH_VOLATILITY", "LOW_VOLATILITY", "NEWS_DRIVEN", "UNKNOWN"]


def smoothed(raw: DataFrame, hold: int = 12, confirm: int = 3, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """``regime`` from ``raw_regime``, segment by segment, however many tasks a segment takes.

    Each chunk of time becomes a map between the states of the smoothing automaton; the maps of a segment are
    followed in order, one small row a chunk, and give each chunk the state that it starts from.
    """
    machine, by = Automaton(REGIMES, hold, confirm), ["instrument", "segment", "__chunk"]
    rows = cut(raw.withColumn("__chunk", chunk_of("open_time", chunk_seconds)))  # read twice
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)

    def to_map(key, t):
        states = machine.chunk(t.sort_by("open_time").column("raw_regime").to_pylist())
        return pa.table({**{c: pa.array([k.as_py()], t.schema.field(c).type) for c, k in zip(by, key)}, "m": pa.array([states.tolist()], pa.list_(pa.int32()))})

    maps = rows.select(*by, "open_time", "raw_regime").groupBy(*by).applyInArrow(to_map, f"{kinds}, m array<int>")
    starts = (maps.groupBy("instrument", "segment").agg(F.array_sort(F.collect_list(F.struct(F.col("__chunk").alias("c"), "m"))).alias("s"))
              .select("instrument", "segment", F.explode(F.expr("""aggregate(s, struct(0 as state, cast(array() as array<struct<c: bigint, start: int>>) as out),
                  (t, r) -> struct(r.m[t.state] as state, array_append(t.out, struct(r.c as c, t.state as start)) as out), t -> t.out)""")).alias("o"))
              .select("instrument", "segment", F.col("o.c").alias("__chunk"), F.col("o.start").alias("__start")))

    def smooth(t):
        t = t.sort_by("open_time")
        regime = machine.run(t.column("raw_regime").to_pylist(), t.column("__start")[0].as_py())
        return t.drop_columns(["__start"]).append_column("regime", pa.array(regime, pa.string()))

    out = rows.join(starts, by).select(*rows.columns, "__start").groupBy(*by).applyInArrow(smooth, StructType([*rows.schema.fields, StructField("regime", StringType())]))
    return out.drop("__chunk")


def hash_chain(labelled: DataFrame) -> DataFrame:
    """``prefix_hash``: the running SHA-256 of each segment's times and raw labels.

    A chain has no short cut, so a segment is one task's work; it streams through it and is never held.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, link = None, b""
        for b in batches:
            chain = []
            for instrument, segment, at, label in zip(*(b.column(c).to_pylist() for c in ("instrument", "segment", "__at", "raw_regime"))):
                if (instrument, segment) != last:
                    last, link = (instrument, segment), b""
                link = hashlib.sha256(link + f"{at}|{label}".encode()).digest()
                chain.append(link.hex())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(chain, pa.string())], names=[*b.schema.names[:-1], "prefix_hash"])

    dealt = labelled.repartition("instrument", "segment").sortWithinPartitions("instrument", "segment", "open_time")
    dealt = dealt.withColumn("__at", F.date_format("open_time", "yyyy-MM-dd'T'HH:mm:ss"))
    return dealt.mapInArrow(run, StructType([*labelled.schema.fields, StructField("prefix_hash", StringType())]))


def regime_run(b: DataFrame, marks: DataFrame) -> DataFrame:
    """Bars and marks (mark_at, known_at, kind news or macro) -> labelled bars, end to end.

    Indicators restart in every segment; a bar sees the marks of the four hours before its close
    that were known by then; ``available_at`` is when the last input so far in the segment became
    known. Bars may say in ``effective_at`` when they became known, marks in ``instrument`` whom they concern.
    """
    ind = indicators(bars.segments(b))
    seen = asof.interval_counts(ind, marks, "close_time", "mark_at", SPAN_SECONDS, "kind", ["news", "macro"], known_col="known_at",
                               key=["instrument"] if "instrument" in marks.columns else None)
    regime, confidence = rule_regime()
    known = F.greatest(F.coalesce("effective_at", "close_time") if "effective_at" in b.columns else F.col("close_time"), "newest_known")
    w = Window.partitionBy("instrument", "segment").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    raw = (seen.withColumn("available_at", F.max(known).over(w)).withColumn("raw_regime", regime).withColumn("confidence", confidence)
           .withColumn("stat_regime", statistical_regime()))
    return hash_chain(smoothed(raw))


def regime_metrics(run: DataFrame, state: str = "regime") -> DataFrame:
    """Points by regime, unknown share, mean run length, most switches a day, agreement of rule and statistics, and the gates."""
    run = cut(run.select("instrument", "segment", "open_time", "close_time", "available_at", "raw_regime", "stat_regime", state))  # read three times
    base = run.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(state) == "UNKNOWN").cast("double")).alias("unknown_ratio"),
        F.avg(F.when(F.col("raw_regime") != "UNKNOWN", (F.col("raw_regime") == F.col("stat_regime")).cast("double"))).alias("agreement"),
        F.count_if(F.col("available_at") > F.col("close_time")).alias("violations"),
        *[F.count_if(F.col(state) == r).alias(f"n_{r}") for r in REGIMES])
    # A run also ends with its segment.
    runs = windows.state_runs(run.select("instrument", "open_time", F.struct(state, "segment").alias("s")), ["instrument"], "open_time", "s").withColumn(state, F.col(f"s.{state}"))
    length = runs.where(F.col(state) != "UNKNOWN").groupBy("instrument").agg(F.avg("n").alias("mean_run"))
    per_day = windows.daily_switches(runs, ["instrument"], state)
    switches = per_day.groupBy("instrument").agg(F.max("switches").alias("max_switches"))
    m = base.join(length, "instrument", "left").join(switches, "instrument", "left").withColumn("max_switches", F.coalesce("max_switches", F.lit(0)))
    gates = ((F.col("unknown_ratio") <= 0.01) & (F.coalesce("mean_run", F.lit(0.0)) >= 12) & (F.col("max_switches") <= 6)
             & (F.coalesce("agreement", F.lit(0.0)) >= 0.8) & (F.col("violations") == 0))
    return m.withColumn("passed", gates)
