"""Mixing sources to target weights by pivotal dependent rounding, with Spark expressions only.

Each document has a fractional number of copies, the same for a whole source. Pairs of documents
exchange mass, weighted by their sizes so that the source's words stay exactly as they were, until
one of the two is whole; the other goes on. A block of documents is folded in one expression and
leaves one residual; residuals are blocks of the next level, up a tree with a fixed fan-in. Only
the last residual of a source is rounded on its own, so its words miss the target by less than one
document. Every draw is a hash, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

WORD = r"[^\x20\x09-\x0D]+"
FAN_IN = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes by weight, ``most`` times a source's size at most.

    The excess of the sources at their limit goes to the others by weight. With the sources in
    order of limit over weight, those at their limit are the first ones, so one pass of running
    sums finds them. There is one row per source here.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("w", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("limit") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    backwards = Window.orderBy((F.col("limit") / F.col("w")).desc(), F.col("source").desc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (rows.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
            .withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
            .withColumn("rate", F.col("left") / F.sum("w").over(backwards.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("i", F.row_number().over(order))
            .withColumn("free", F.col("rate") * F.col("w") <= F.col("limit")))
    rows = rows.withColumn("rate", F.min_by(F.when(F.col("free"), F.col("rate")),
                                            F.when(F.col("free"), F.col("i"))).over(whole))
    return rows.select("source", "source_size", F.least(F.col("limit"), F.col("rate") * F.col("w")).alias("target"))


def _fold(items: str, seed: int) -> str:
    """SQL: fold sorted (key, id, size, p) items; acc: the open item and the settled (id, size, up) ones."""
    u = f"(shiftrightunsigned(xxhash64({seed}L, a.open.key, x.key), 11) / 9007199254740992D)"
    up = "least((1D - a.open.p) * a.open.size, x.p * x.size)"
    down = "least(a.open.p * a.open.size, (1D - x.p) * x.size)"
    settle = lambda it, v: f"array_append(a.done, struct({it}.id as id, {it}.size as size, {v} as up))"
    go_on = lambda it, p: f"struct({it}.key as key, {it}.id as id, {it}.size as size, {p} as p)"
    step = f"""
      CASE WHEN {u} * ({up} + {down}) < {down} THEN
        CASE WHEN (1D - a.open.p) * a.open.size <= x.p * x.size
             THEN struct({go_on('x', f'x.p - {up} / x.size')} as open, {settle('a.open', 1)} as done)
             ELSE struct({go_on('a.open', f'a.open.p + {up} / a.open.size')} as open, {settle('x', 0)} as done) END
      ELSE
        CASE WHEN a.open.p * a.open.size <= (1D - x.p) * x.size
             THEN struct({go_on('x', f'x.p + {down} / x.size')} as open, {settle('a.open', 0)} as done)
             ELSE struct({go_on('a.open', f'a.open.p - {down} / a.open.size')} as open, {settle('x', 1)} as done) END
      END"""
    none = "cast(array() as array<struct<id: bigint, size: bigint, up: int>>)"
    return f"aggregate(slice({items}, 2, size({items})), struct({items}[0] as open, {none} as done), (a, x) -> {step})"


def round_fractions(items: DataFrame, seed: int) -> DataFrame:
    """items: source, key, id, size > 0, p in (0, 1). Returns (source, id, size, up) with up 0 or 1.

    Blocks hold about FAN_IN items whatever the source's share of the rows: a source is split by
    hash into as many blocks as its count asks for.
    """
    most = items.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    counts = items.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    level = cut(items.join(counts, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "key", "id", "size", "p",
        F.pmod(F.xxhash64(F.lit(seed), "key"), F.ceil(F.col("n") / FAN_IN)).alias("block"), F.ceil(F.col("n") / FAN_IN).alias("blocks")))
    settled = []
    while True:
        folded = (level.groupBy("source", "block", "blocks")
                  .agg(F.array_sort(F.collect_list(F.struct("key", "id", "size", "p"))).alias("items"))
                  .select("source", "block", "blocks", F.expr(_fold("items", seed + len(settled))).alias("f")))
        folded = cut(folded)
        settled.append(folded.select("source", F.explode("f.done").alias("d")).select("source", "d.id", "d.size", "d.up"))
        last = most <= FAN_IN
        if last:
            chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed - 1), "f.open.key"), 11) / F.lit(float(2**53))
            settled.append(folded.select("source", "f.open.id", "f.open.size", (chance < F.col("f.open.p")).cast("int").alias("up")))
            break
        up = F.ceil(F.col("blocks") / FAN_IN)
        level = folded.select("source", "f.open.*", (F.col("block") % up).alias("block"), up.alias("blocks"))
        most = -(-most // FAN_IN)
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
                seed: int = 20240517, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, source, size, source_size, target, copies, taken.

    Size is the number of words; null texts and texts without words have size 0 and are never
    taken. Sources are ordered by code point with null last and weighted in turn. ``copies`` is a
    whole number, at most ``most``; ``taken`` = copies * size. An empty table gives no rows;
    repeated rows count each; columns other than the three named are not read.
    """
    sized = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"),
                            word_count(F.col(text_col)).alias("size"),
                            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("key")))
    targets = cut(source_targets(sized, weights, share, most))
    t = targets.withColumnRenamed("source", "s")
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("s"))).select(
        "id", "source", "size", "key", "source_size", "target",
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0)).alias("x"))
    rows = rows.withColumn("whole", F.floor("x")).withColumn("p", F.col("x") - F.col("whole"))
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    settled = rows.where(~open_).select("source", "id", "size", F.lit(0).alias("up")).unionByName(
        round_fractions(rows.where(open_).select("source", "key", "id", "size", "p"), seed))
    whole = F.floor(F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0)))
    out = settled.join(t, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", (whole + F.col("up")).cast("long"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                      F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0)).cast("long").alias("copies"),
                      F.when(F.col("size") > 0, F.col("copies") * F.col("size")).otherwise(F.lit(0)).cast("long").alias("taken"))
