"""Streaming forms of the incremental steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.hysteresis import State, step
from ..operators.store import new_rows


def complete_bars_stream(minutes: DataFrame, bucket: str, need: int, lateness: str) -> DataFrame:
    """Tumbling bars that appear once the watermark closes them, complete ones only.

    ``lateness`` must exceed how late the source may be; a base bar that comes later is left out.
    """
    g = (minutes.withWatermark("open_time", lateness).groupBy("instrument", F.window("open_time", bucket))
         .agg(F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"),
              F.sum("volume").alias("volume"), F.size(F.collect_set("open_time")).alias("times"), F.count(F.lit(1)).alias("n")))
    return g.where((F.col("n") == need) & (F.col("times") == need)).select("instrument", F.col("window.start").alias("open_time"), F.col("window.end").alias("close_time"), "open", "high", "low", "close", "volume")


def first_seen_stream(rows: DataFrame, keys: list[str], at: str, lateness: str) -> DataFrame:
    """Rows whose key was not seen within the lateness before."""
    return rows.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)


def append_new(path: str, key: list[str], order: list[str]):
    """For foreachBatch: append what the table at ``path`` lacks. A batch that runs again adds nothing."""
    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            existing = spark.read.parquet(path)
        except Exception as e:  # the first batch creates the table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            existing = batch.limit(0)
        new_rows(batch, existing, [key], [F.col(c) for c in order]).write.mode("append").parquet(path)
    return store


def with_dead_letters(path: str, at: str, lateness_seconds: int):
    """For foreachBatch: rows in time go to ``path``/rows, rows behind the watermark to ``path``/late, none is lost.

    The watermark of a batch is the greatest time of the batches before it less the lateness, as with
    ``withWatermark``, and is stored with each batch; late rows carry it. A batch that runs again replaces
    what it wrote. Rows without a time are in time.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id:
            before = spark.read.schema("newest timestamp").parquet(f"{path}/marks/batch={batch_id - 1}").first()[0]
        mark = F.lit(before).cast("timestamp")
        newest = batch.agg(F.greatest(F.max(F.col(at).cast("timestamp")), mark).alias("newest"))
        late = F.coalesce(F.col(at).cast("timestamp") < mark - F.expr(f"make_dt_interval(0, 0, 0, {lateness_seconds})"), F.lit(False))
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        (batch.where(late).withColumn("behind", mark - F.expr(f"make_dt_interval(0, 0, 0, {lateness_seconds})"))
         .write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}"))
        newest.write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")
    return store


class Smoother(StatefulProcessor):
    """Keeps each series' smoothing state; rows of a batch are taken in time order."""

    def __init__(self, hold: int = 12, confirm: int = 3):
        self.hold, self.confirm = hold, confirm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("s", "active string, held int, pending string, count int, segment bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("open_time").reset_index(drop=True)
        kept = self.state.get() if self.state.exists() else None
        s, segment = (State(*kept[:4]), kept[4]) if kept else (State(), None)
        out = []
        for label, seg in zip(pdf["raw_regime"], pdf["segment"]):
            s = step(s if seg == segment else State(), label, self.hold, self.confirm)
            segment = seg
            out.append(s.active)
        self.state.update((*s, int(segment)))
        yield pd.DataFrame({"instrument": key[0], "open_time": pdf["open_time"], "segment": pdf["segment"], "regime": out})

    def close(self) -> None:
        pass


def smoothed_stream(labels: DataFrame, hold: int = 12, confirm: int = 3) -> DataFrame:
    """(instrument, open_time, segment, raw_regime) stream -> smoothed labels, with the state on disk."""
    return labels.groupBy("instrument").transformWithStateInPandas(
        Smoother(hold, confirm), outputStructType="instrument string, open_time timestamp, segment bigint, regime string", outputMode="Append", timeMode="None")


class Staleness(StatefulProcessor):
    """An idle-source clock: one timer per source, due ``limit_ms`` after its last success.

    A source without a success is due that long after its first run. Each later success moves the
    timer; a run that failed only starts the clock of a new source. Times are milliseconds.
    """

    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "first bigint, last bigint, due bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, due = self.state.get() if self.state.exists() else (None, None, None)
        for pdf in rows:
            times = pdf["at_ms"].dropna()
            good = pdf["at_ms"][pdf["good"].fillna(False).astype(bool)].dropna()
            first = min((int(t) for t in (first, times.min()) if not pd.isna(t)), default=None) if len(times) else first
            last = max((int(t) for t in (last, good.max()) if not pd.isna(t)), default=None) if len(good) else last
        since = first if last is None else last
        if since is not None and since + self.limit_ms != due:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            due = since + self.limit_ms
            self.handle.registerTimer(due)
            self.state.update((first, last, due))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, last, due = self.state.get()
        yield pd.DataFrame({"source": [key[0]], "last_ms": pd.array([last], dtype="Int64"), "due_ms": [due]})

    def close(self) -> None:
        pass


def stale_sources_stream(runs: DataFrame, lateness: str, limit_seconds: int = 5400) -> DataFrame:
    """(source, last_success, stale_at) once the watermark passes ``limit_seconds`` without a success.

    Every run reaches the clock and moves the watermark, failed ones too, so that time goes on while
    a source is silent or fails; last_success is null for a source that never had one. A success that
    is later than the watermark moves its source's time again, and so may be reported again. Runs
    without a time are ignored. Needs the RocksDB state store.
    """
    timed = runs.withWatermark("started_at", lateness).select(
        "source", "started_at", F.unix_millis("started_at").alias("at_ms"), (F.col("status") == "SUCCESS").alias("good"))
    fired = timed.groupBy("source").transformWithStateInPandas(
        Staleness(limit_seconds * 1000), outputStructType="source string, last_ms bigint, due_ms bigint", outputMode="Append", timeMode="EventTime")
    return fired.select("source", F.timestamp_millis("last_ms").alias("last_success"), F.timestamp_millis("due_ms").alias("stale_at"))
