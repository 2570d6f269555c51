"""Source health, batch results and table invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import failure_streak


def source_health(sources: DataFrame, runs: DataFrame, since: Column, as_of: Column, stale_seconds: int, streak_limit: int = 3) -> DataFrame:
    """State of every source: counts in the window, failure streak, last success ever, and one state."""
    known = runs.where(F.col("started_at") <= as_of)
    ever = known.groupBy("source").agg(F.max(F.when(F.col("status") == "SUCCESS", F.col("started_at"))).alias("last_success"))
    seen = known.where(F.col("started_at") >= since)
    n = lambda s: F.count_if(F.col("status") == s)
    counts = seen.groupBy("source").agg(F.count(F.lit(1)).alias("runs"), n("SUCCESS").alias("succeeded"), n("PARTIAL_FAILED").alias("partial"),
                                        n("FAILED").alias("failed"), F.count_if(F.col("status").isin("PENDING", "RUNNING")).alias("in_flight"))
    streak = failure_streak(seen.where(~F.col("status").isin("PENDING", "RUNNING")), ["source"], [F.col("started_at").desc(), F.col("run_id").desc()], F.col("status") == "FAILED")
    j = sources.join(counts, "source", "left").join(streak, "source", "left").join(ever, "source", "left")
    j = j.fillna(0, ["runs", "succeeded", "partial", "failed", "in_flight", "streak"])
    last = F.col("last_success")
    old = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(last.cast("timestamp")) > stale_seconds
    state = (F.when(~F.col("enabled"), "DISABLED").when((F.col("runs") == 0) & last.isNull(), "NEVER_RUN").when(F.col("streak") >= streak_limit, "FAILED")
             .when((F.col("failed") > 0) & (F.col("succeeded") == 0), "FAILED").when(last.isNull(), "NEVER_SUCCEEDED")
             .when((F.col("failed") > 0) | (F.col("partial") > 0), "DEGRADED").when(old, "STALE").when(F.col("runs") == 0, "UNKNOWN")
             .when(F.col("succeeded") > 0, "HEALTHY").otherwise("UNKNOWN"))
    return j.withColumn("state", state)


def overall_state(health: DataFrame) -> DataFrame:
    """The worst state of enabled sources; UNKNOWN if none is enabled."""
    on = F.col("state") != "DISABLED"
    bad = F.col("state").isin("FAILED", "NEVER_SUCCEEDED")
    weak = F.col("state").isin("DEGRADED", "STALE", "NEVER_RUN", "UNKNOWN")
    g = health.agg(F.count_if(on).alias("enabled"), F.count_if(on & bad).alias("failed"), F.count_if(on & weak).alias("degraded"), F.count_if(F.col("state") == "HEALTHY").alias("healthy"))
    return g.withColumn("state", F.when(F.col("enabled") == 0, "UNKNOWN").when(F.col("failed") > 0, "FAILED").when(F.col("degraded") > 0, "DEGRADED").otherwise("HEALTHY"))


#: Buckets of processing results.
PROCESSED = {"success": ["ACCEPTED", "SUCCESS"], "rejected": ["REJECTED", "DUPLICATE"], "failed": ["FAILED"]}


def processor_health(sources: DataFrame, raw_items: DataFrame, results: DataFrame) -> DataFrame:
    """Per source: raw items, results by bucket (anything else is in_flight) and the processor's state.

    OBSERVED with results, NOT_OBSERVED where raw items have none, NO_INPUT without either. ``raw_items`` and
    ``results`` (source, outcome) are those of the window; a source that has none of them has a row too.
    """
    seen = raw_items.groupBy("source").agg(F.count(F.lit(1)).alias("raw_items"))
    bucket = F.lit("in_flight")
    for name, outcomes in PROCESSED.items():
        bucket = F.when(F.col("outcome").isin(outcomes), name).otherwise(bucket)
    counts = results.withColumn("__b", bucket).groupBy("source").agg(*[F.count_if(F.col("__b") == b).alias(f"processed_{b}") for b in (*PROCESSED, "in_flight")])
    out = sources.select("source", "enabled").join(seen, "source", "left").join(counts, "source", "left").na.fill(0)
    total = sum((F.col(f"processed_{b}") for b in (*PROCESSED, "in_flight")), F.lit(0))
    return out.withColumn("processor_state", F.when(total > 0, "OBSERVED").when(F.col("raw_items") > 0, "NOT_OBSERVED").otherwise("NO_INPUT"))


def scheduler_summary(jobs: DataFrame) -> DataFrame:
    """One row over slots (status, retry_count, scheduled_at, output_json): counts by status, retries, entries of sources in
    the outputs, slots whose output reports none, and the last slot."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    reported = F.json_array_length(F.get_json_object("output_json", "$.sources"))
    return jobs.agg(F.count(F.lit(1)).alias("slots"), n("SUCCESS").alias("success"), n("PARTIAL_FAILED").alias("partial_failed"), n("FAILED").alias("failed"),
                    n("PENDING", "RUNNING", "RETRYING").alias("in_flight"), n("CANCELLED").alias("other"), F.coalesce(F.sum(F.coalesce("retry_count", F.lit(0))), F.lit(0)).alias("retries"),
                    F.coalesce(F.sum(reported), F.lit(0)).cast("long").alias("per_source_entries"), F.count_if(reported.isNull()).alias("slots_without_output"), F.max("scheduled_at").alias("last_slot_at"))


def overall_health(health: DataFrame, processing: DataFrame) -> DataFrame:
    """(state, reasons) of collection and processing together: NO_SOURCES, DISABLED, FAILED, DEGRADED with every reason, or HEALTHY.

    ``health``: of ``source_health``; ``processing``: of ``processor_health``.
    """
    on = F.col("enabled")
    h = health.agg(F.count(F.lit(1)).alias("sources"), F.count_if(on).alias("on"), F.count_if(on & (F.col("state") == "FAILED")).alias("failed"), F.count_if(on & (F.col("state") != "HEALTHY")).alias("weak"))
    total = sum((F.col(f"processed_{b}") for b in (*PROCESSED, "in_flight")), F.lit(0))
    p = processing.agg(F.coalesce(F.sum("raw_items"), F.lit(0)).alias("raw"), F.coalesce(F.sum(total), F.lit(0)).alias("results"), F.coalesce(F.sum("processed_failed"), F.lit(0)).alias("broken"),
                       F.count_if(on & (F.col("processor_state") == "NOT_OBSERVED")).alias("blind"))
    whole_blind = (F.col("results") == 0) & (F.col("raw") > 0)
    reasons_ = F.array_compact(F.array(F.when(F.col("weak") > 0, "sources_not_healthy"), F.when(whole_blind, "no_processing_results").when(F.col("blind") > 0, "sources_without_results"),
                                       F.when(F.col("broken") > 0, "processing_failures")))
    state = (F.when(F.col("sources") == 0, "NO_SOURCES").when(F.col("on") == 0, "DISABLED").when(F.col("failed") > 0, "FAILED").when(F.size("reasons") > 0, "DEGRADED").otherwise("HEALTHY"))
    return h.join(p).withColumn("reasons", reasons_).select(state.alias("state"), F.when(state == "DEGRADED", F.col("reasons")).otherwise(F.array()).alias("reasons"))  # one row each


def batch_status(inserted: Column, failed: Column) -> Column:
    """FAILED if only failures, PARTIAL_FAILED if some, else SUCCESS."""
    return F.when((failed > 0) & (inserted == 0), "FAILED").when(failed > 0, "PARTIAL_FAILED").otherwise("SUCCESS")


def invariants(checks: dict[str, tuple[DataFrame, Column]], unique: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(check, violations): rows that break a rule, and keys that occur more than once."""
    parts = [df.agg(F.count_if(bad).alias("violations")).select(F.lit(name).alias("check"), "violations") for name, (df, bad) in checks.items()]
    parts += [df.groupBy(*key).count().agg(F.count_if(F.col("count") > 1).alias("violations")).select(F.lit(name).alias("check"), "violations")
              for name, (df, key) in unique.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def processing_report(outcomes: DataFrame, by: list[str], first: int = 5) -> DataFrame:
    """Counts by outcome and the first distinct warnings."""
    n = lambda s: F.count_if(F.col("outcome") == s)
    return outcomes.groupBy(*by).agg(*[n(s).alias(s.lower()) for s in ("ACCEPTED", "DUPLICATE", "REJECTED", "FAILED")],
                                     F.slice(F.array_sort(F.collect_set("warning")), 1, first).alias("warnings"))


def corpus_profile(posts: DataFrame, by: str, length: str, url: str, limit: int) -> DataFrame:
    return posts.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(length).alias("shortest"), F.percentile(length, F.lit(0.5)).alias("median"), F.max(length).alias("longest"),
                                 F.count_if(F.col(url).isNull() | (F.col(url) == "")).alias("without_url"), F.count_if(F.col(length) > limit).alias("too_long"))


def expected_records(window_seconds: Column, step_seconds: int, share: float = 0.5) -> Column:
    """Fewest records that a window of this length should give."""
    return F.greatest(F.floor(window_seconds / step_seconds * share), F.lit(1)).cast("long")


def state_changes(snapshots: DataFrame, scope: str, order: str) -> DataFrame:
    """Events between snapshots (gap, reasons, ready): first, gap_changed, reasons_changed, ready_up, ready_down."""
    from pyspark.sql import Window

    w = Window.partitionBy(scope).orderBy(order)
    d = snapshots.withColumn("__p", F.lag(F.struct("gap", "reasons", "ready")).over(w))
    new = F.col("__p").isNull()
    kinds = F.array_compact(F.array(
        F.when(new, "first"), F.when(~new & ~F.col("gap").eqNullSafe(F.col("__p.gap")), "gap_changed"),
        F.when(~new & ~F.col("reasons").eqNullSafe(F.col("__p.reasons")), "reasons_changed"),
        F.when(~new & F.col("ready") & ~F.col("__p.ready"), "ready_up"), F.when(~new & ~F.col("ready") & F.col("__p.ready"), "ready_down")))
    return d.withColumn("event", F.explode(kinds)).drop("__p")
