"""As-of joins: the newest value known by a time, the first value strictly after one, and intervals.

Both sides are put into one ordered sequence per key, so a join is one window instead of a search
per row. The sequence is cut into chunks of time: inside a chunk a window carries the value, and a
small window over chunk summaries carries it from chunk to chunk. A key that holds most of the
rows is therefore spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _sequence(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], tie: list[str], chunk: str):
    payload = F.struct(*[F.col(v).alias(v) for v in values])
    kept = F.struct(*[F.col(c).alias(c) for c in left.columns])
    a = left.select(*by, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), kept.alias("__row"))
    b = right.select(*by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), payload.alias("__value"), F.struct(F.col(right_time), *tie).alias("__tie"))
    for k in by:  # a null key matches nothing
        b = b.where(F.col(k).isNotNull())
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn("__chunk", F.date_trunc(chunk, F.col("__t")))


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str],
                  tie: list[str] | None = None, chunk: str = "month") -> DataFrame:
    """Left rows with ``values`` of the last right row whose time is <= theirs, else null.

    Of right rows at one time the one that is last in ``tie`` counts.
    """
    tie = tie or values
    seq = _sequence(left, right, by, left_time, right_time, values, tie, chunk)
    inside = Window.partitionBy(*by, "__chunk").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    ends = seq.where("__side = 0").groupBy(*by, "__chunk").agg(F.max_by("__value", "__tie").alias("__end"))
    chunks = seq.select(*by, "__chunk").distinct().join(ends, [*by, "__chunk"], "left")
    before = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(*by, "__chunk", F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    found = seq.withColumn("__found", F.last("__value", ignorenulls=True).over(inside)).where("__side = 1").join(carry, [*by, "__chunk"], "left")
    found = found.withColumn("__found", F.coalesce("__found", "__carry"))
    return found.select("__row.*", *[F.col(f"__found.{v}").alias(v) for v in values])


def asof_forward_strict(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str],
                        tie: list[str] | None = None, chunk: str = "month") -> DataFrame:
    """Left rows with ``values`` of the first right row strictly after their time, else null."""
    tie = tie or values
    seq = _sequence(left, right, by, left_time, right_time, values, tie, chunk)
    # Backwards in time, so that the frame grows; at equal times left rows come first and see no right row of their own time.
    inside = Window.partitionBy(*by, "__chunk").orderBy(*[F.col(c).desc() for c in ("__t", "__side", "__tie")]).rowsBetween(Window.unboundedPreceding, -1)
    starts = seq.where("__side = 0").groupBy(*by, "__chunk").agg(F.min_by("__value", "__tie").alias("__start"))
    chunks = seq.select(*by, "__chunk").distinct().join(starts, [*by, "__chunk"], "left")
    after = Window.partitionBy(*by).orderBy(F.col("__chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(*by, "__chunk", F.last("__start", ignorenulls=True).over(after).alias("__carry"))
    found = seq.withColumn("__found", F.last("__value", ignorenulls=True).over(inside)).where("__side = 1").join(carry, [*by, "__chunk"], "left")
    found = found.withColumn("__found", F.coalesce("__found", "__carry"))
    return found.select("__row.*", *[F.col(f"__found.{v}").alias(v) for v in values])


def interval_counts(ends: DataFrame, marks: DataFrame, end_col: str, mark_col: str, span_seconds: int, kind_col: str, kinds: list[str],
                    known_col: str | None = None, key: list[str] | None = None) -> DataFrame:
    """Rows of ``ends`` with the count of marks in (end - span, end], by kind, and ``newest_mark``, the time of the newest.

    Marks are copied to the few buckets of length ``span`` that an end can look into, so the join
    is an equality on the bucket with a range left over. With ``known_col`` a mark counts only if
    known by the end, and ``newest_known`` is when the last of those counted became known.
    """
    key = key or []
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / span_seconds)
    e = ends.withColumn("__id", F.monotonically_increasing_id()).withColumn("__b", bucket(end_col))
    names = list(dict.fromkeys([mark_col, kind_col, *([known_col] if known_col else [])]))
    m = marks.select(*[F.col(k).alias(f"__k_{k}") for k in key], *[F.col(n).alias(f"__m_{n}") for n in names])
    m = m.withColumn("__mb", F.explode(F.array(bucket(f"__m_{mark_col}"), bucket(f"__m_{mark_col}") + 1)))
    inside = (F.col(f"__m_{mark_col}") <= F.col(end_col)) & (F.col(f"__m_{mark_col}") > F.col(end_col) - F.expr(f"interval {span_seconds} seconds"))
    if known_col:
        inside &= F.col(f"__m_{known_col}") <= F.col(end_col)
    for k in key:
        inside &= F.col(k) == F.col(f"__k_{k}")
    hits = e.join(m, (F.col("__b") == F.col("__mb")) & inside, "left")
    counts = [F.count_if(F.col(f"__m_{kind_col}") == k).alias(f"n_{k}") for k in kinds]
    known = [F.max(f"__m_{known_col}").alias("newest_known")] if known_col else []
    return hits.groupBy("__id", *ends.columns).agg(*counts, F.max(f"__m_{mark_col}").alias("newest_mark"), *known).drop("__id")


def vintage_asof(releases: DataFrame, key: list[str], as_of, released: str = "released_at", vintage_end: str = "vintage_end_at") -> DataFrame:
    """Per observation the newest release visible at ``as_of``, unless its vintage has ended by then."""
    newest = Window.partitionBy(*key).orderBy(F.col(released).desc())
    return (releases.where(F.col(released) <= as_of).withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")
            .where(F.col(vintage_end).isNull() | (F.col(vintage_end) > as_of)))


def range_join(rows: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, how: str = "left_semi") -> DataFrame:
    """Rows with a range [start, end) of the same key around ``at``; an open end is null."""
    r = ranges.select(F.col(key).alias("__k"), F.col(start).alias("__s"), F.col(end).alias("__e"))
    inside = (F.col(key) == F.col("__k")) & (F.col(at) >= F.col("__s")) & (F.col("__e").isNull() | (F.col(at) < F.col("__e")))
    return rows.join(r, inside, how)
