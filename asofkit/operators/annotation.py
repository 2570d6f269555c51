"""Agreement of annotators, evaluation of extractors against gold cells, and samples for review."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shared import cut

ABSENT = "∅"


def agreement_pattern(values: list[Column]) -> Column:
    """unanimous, blank (all blank), two_vs_one or three_way for three values; null is blank."""
    a, b, c = values
    same = lambda x, y: x.eqNullSafe(y).cast("int")
    pairs = same(a, b) + same(a, c) + same(b, c)
    return (F.when(a.isNull() & b.isNull() & c.isNull(), "blank").when(pairs == 3, "unanimous").when(pairs == 1, "two_vs_one").otherwise("three_way"))


def majority(values: list[Column]) -> Column:
    a, b, c = values
    return F.when(a.eqNullSafe(b) | a.eqNullSafe(c), a).when(b.eqNullSafe(c), b)


def agreement(cells: DataFrame, annotators: list[str]) -> DataFrame:
    """Patterns, pairwise agreement and blank rates by field."""
    v = [F.col(x) for x in annotators]
    pat = agreement_pattern(v)
    pairs = [(i, j) for i in range(3) for j in range(i + 1, 3)]
    return cells.groupBy("field").agg(
        *[F.count_if(pat == p).alias(p) for p in ("unanimous", "blank", "two_vs_one", "three_way")],
        *[F.avg(v[i].eqNullSafe(v[j]).cast("double")).alias(f"agree_{annotators[i]}_{annotators[j]}") for i, j in pairs],
        *[F.avg(x.isNull().cast("double")).alias(f"blank_{n}") for x, n in zip(v, annotators)])


def row_agreement(cells: DataFrame, annotators: list[str]) -> DataFrame:
    """Rows whose cells all agree: full counts blanks as values, strict needs values."""
    v = [F.col(x) for x in annotators]
    pat = agreement_pattern(v)
    rows = cells.groupBy("post_id").agg(F.bool_and(pat.isin("unanimous", "blank")).alias("full"), F.bool_and(pat == "unanimous").alias("strict"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("full").alias("full"), F.count_if("strict").alias("strict"))


def ground_truth(cells: DataFrame, annotators: list[str], decisions: DataFrame) -> DataFrame:
    """Gold per cell: unanimous values, else a human decision, else the majority, else open.

    ``decisions`` (post_id, field, value) overturns a majority if it differs from it.
    """
    v = [F.col(x) for x in annotators]
    c = cells.withColumn("pattern", agreement_pattern(v)).withColumn("majority", majority(v))
    j = c.join(decisions.select("post_id", "field", F.col("value").alias("decided"), F.lit(True).alias("__d")), ["post_id", "field"], "left")
    decided = F.coalesce(F.col("__d"), F.lit(False))
    whole = F.col("pattern").isin("unanimous", "blank")
    source = F.when(whole, F.col("pattern")).when(decided, "human").when(F.col("pattern") == "two_vs_one", "majority").otherwise("open")
    value = F.when(whole | (~decided & (F.col("pattern") == "two_vs_one")), F.col("majority")).when(decided, F.col("decided"))
    over = ~whole & decided & (F.col("pattern") == "two_vs_one") & ~F.col("decided").eqNullSafe(F.col("majority"))
    return j.select("post_id", "field", value.alias("value"), source.alias("gold_source"), over.alias("overturned"))


def coverage(truth: DataFrame) -> DataFrame:
    return truth.groupBy("field").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("gold_source") != "open").alias("settled"),
                                      F.count_if("overturned").alias("overturned"), F.count_if(F.col("gold_source") == "human").alias("human"))


def missing_cells(truth: DataFrame, posts: DataFrame, fields: list[str]) -> DataFrame:
    """Cells of the grid posts x fields that the truth lacks."""
    grid = posts.select("post_id", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    return grid.join(truth.select("post_id", "field"), ["post_id", "field"], "left_anti")


def outcome(gold: Column, pred: Column) -> Column:
    return (F.when(gold.isNull() & pred.isNull(), "absent").when(gold.isNull(), "spurious").when(pred.isNull(), "missed")
            .when(gold == pred, "correct").otherwise("wrong"))


OUTCOMES = ["absent", "spurious", "missed", "correct", "wrong"]


def _metrics() -> list[Column]:
    n = {o: F.count_if(F.col("outcome") == o) for o in OUTCOMES}
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    present = n["missed"] + n["correct"] + n["wrong"]
    return [*[n[o].alias(o) for o in OUTCOMES], F.count_if(F.col("outcome") == "NOT_EVALUATED").alias("not_evaluated"),
            div(n["correct"], present).alias("recall"), div(n["correct"], n["correct"] + n["wrong"] + n["spurious"]).alias("precision"),
            div(n["correct"] + n["absent"], F.count_if(F.col("outcome") != "NOT_EVALUATED")).alias("exact")]


def evaluation(cells: DataFrame) -> DataFrame:
    """Outcome counts and rates by field, and over all fields as ``(all)``.

    Cells that are NOT_EVALUATED count apart and are in no denominator.
    """
    g = cells.rollup("field").agg(F.grouping("field").alias("__all"), *_metrics())
    return g.withColumn("field", F.when(F.col("__all") == 1, "(all)").otherwise(F.col("field"))).drop("__all")


def confusion(cells: DataFrame, labels: list[str]) -> DataFrame:
    """Gold by prediction in canonical order; absent values are the last row and column."""
    c = cells.select(F.coalesce("gold", F.lit(ABSENT)).alias("gold"), F.coalesce("pred", F.lit(ABSENT)).alias("pred"))
    out = c.groupBy("gold").pivot("pred", [*labels, ABSENT]).count()
    return out.select("gold", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(f"pred_{'absent' if x == ABSENT else x}") for x in [*labels, ABSENT]])


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer alignment of two runs' cells with the problem of each pair, if any."""
    key = ["post_id", "field"]
    a = left.select(*key, F.col("gold").alias("gold_a"), F.col("outcome").alias("outcome_a"))
    b = right.select(*key, F.col("gold").alias("gold_b"), F.col("outcome").alias("outcome_b"))
    j = a.join(b, key, "full_outer")
    return j.withColumn("problem", F.when(F.col("outcome_b").isNull(), "only_in_a").when(F.col("outcome_a").isNull(), "only_in_b")
                        .when(~F.col("gold_a").eqNullSafe(F.col("gold_b")), "gold_differs"))


def changed_cells(pairs: DataFrame) -> DataFrame:
    """fixed: wrong before and right now; regressed: the other way."""
    right = lambda c: F.col(c).isin("correct", "absent")
    p = pairs.where("problem is null")
    kind = F.when(~right("outcome_a") & right("outcome_b"), "fixed").when(right("outcome_a") & ~right("outcome_b"), "regressed")
    return p.withColumn("change", kind).where("change is not null").select("post_id", "field", "change")


def gold_changes(old: DataFrame, new: DataFrame, predictions: DataFrame) -> DataFrame:
    """Cells whose gold differs between versions, and whether the prediction agrees with either."""
    key = ["post_id", "field"]
    j = (old.select(*key, F.col("value").alias("old")).join(new.select(*key, F.col("value").alias("new")), key)
         .where(~F.col("old").eqNullSafe(F.col("new"))).join(predictions.select(*key, "pred"), key, "left"))
    return j.withColumn("agreed_before", F.col("pred").eqNullSafe(F.col("old"))).withColumn("agrees_now", F.col("pred").eqNullSafe(F.col("new")))


def blind_review(answers: DataFrame, key: DataFrame, labels: list[str], wanted: int = 50, threshold: float = 0.8) -> DataFrame:
    """Problems and agreement of review answers (item, label) with the key (item, label)."""
    a = answers.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("label"))
    j = a.join(key.select("item", F.col("label").alias("truth")), "item", "left")
    g = j.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("n") > 1).alias("duplicates"), F.count_if(~F.col("label").isin(labels)).alias("invalid"),
              F.count_if(F.col("truth").isNull()).alias("without_key"), F.count_if(F.col("label") == F.col("truth")).alias("agreed"))
    share = F.coalesce(F.try_divide(F.col("agreed"), F.col("items")), F.lit(0.0))
    clean = (F.col("items") == wanted) & (F.col("duplicates") + F.col("invalid") + F.col("without_key") == 0)
    return g.withColumn("agreement", share).withColumn("passed", clean & (share >= threshold))


def round_robin(df: DataFrame, bucket: Column, order: list[Column], k: int) -> DataFrame:
    """``k`` rows taken from the buckets in turn."""
    d = df.withColumn("bucket", bucket)
    n = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return d.withColumn("turn", n).orderBy("turn", "bucket").limit(k)


def evenly_spaced(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """``k`` rows per label at positions i * (n - 1) / (k - 1), rounded half to even."""
    w = Window.partitionBy(*by)
    d = df.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1)
    spots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround((i * (F.col("__n") - 1) / F.lit(max(k - 1, 1))).cast("decimal(20,6)"), 0).cast("int"))
    return d.where(F.array_contains(spots, F.col("__i"))).drop("__n", "__i")


#: Upper bounds of the lengths of texts: short, medium and long ones.
LENGTHS = [("short", 50), ("medium", 200), ("long", None)]


def first_of_each(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group, through the first of every slice of it, so that no task sorts a whole group."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = Window.partitionBy(*by, "__slice").orderBy(*order)
    d = df.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(slices))).withColumn("__k", F.row_number().over(some)).where(F.col("__k") <= k)
    return d.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__k") <= k).drop("__k", "__slice")


def numbered(df: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """``name``: the place of a row in its group, from 1; groups of any size are dealt by range of (by, order)."""
    dealt = cut(df.repartitionByRange(by, order).withColumn("__p", F.spark_partition_id()))
    sizes = dealt.groupBy(by, "__p").agg(F.count(F.lit(1)).alias("n"))  # a row for each group of a partition
    before = sizes.select(F.col(by).alias("__by"), F.col("__p").alias("__q"), (F.sum("n").over(Window.partitionBy(by).orderBy("__p")) - F.col("n")).alias("__before"))
    d = dealt.join(before, (F.col(by).eqNullSafe(F.col("__by"))) & (F.col("__p") == F.col("__q")))
    inside = F.row_number().over(Window.partitionBy("__p", by).orderBy(order))
    return d.withColumn(name, F.col("__before") + inside).drop("__p", "__by", "__q", "__before")


def stratified_sample(posts: DataFrame, k: int, seed: int = 42, source_cap: float = 0.25, media_quota: int = 10) -> DataFrame:
    """``k`` posts (post_id, source, text, effective_at, has_media), or all if there are fewer, with ``step`` and ``place``.

    Blank texts go; of equal texts (without regard to case and white space) the earliest stays. Posts stand in
    seeded order, and days take turns. Four steps go over them in that order and take what their limits allow: media until the quota;
    then posts while a source holds less than ``source_cap`` of ``k`` and a length bucket less than its third; then without the
    thirds; then without the share of sources.

    What a step takes is decided on a bounded rest: of a (source, length, media) cell only the first ``k`` posts can be
    taken, and as fewer than 1 + 1 / source_cap sources can be full, of a (length, media) cell only the first
    k * (2 + 1 / source_cap) of those. So one small group holds all that may be chosen, however many posts there are.
    """
    key = tx.ascii_key(F.col("text"))
    p = posts.select("post_id", F.coalesce("source", F.lit("")).alias("source"), "text", "effective_at", F.coalesce("has_media", F.lit(False)).alias("has_media"))
    p = p.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("__key", key)
    row = F.struct("post_id", "source", "text", "effective_at", "has_media")
    pool = p.groupBy("__key").agg(F.min_by(row, F.struct("effective_at", "post_id")).alias("r")).select("r.*")
    bucket = F.lit(LENGTHS[-1][0])
    for name, most in reversed(LENGTHS[:-1]):
        bucket = F.when(F.length("text") <= most, name).otherwise(bucket)
    pool = pool.withColumn("bucket", bucket).withColumn("day", F.to_date("effective_at")).withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("post_id").cast("string"))))
    spread = cut(numbered(pool, "day", "__h", "turn").drop("text"))
    there = {r.bucket: r.n for r in spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows
    base, more = divmod(k, len(LENGTHS))
    targets = {name: min(base + (i < more), there.get(name, 0)) for i, (name, _) in enumerate(LENGTHS)}
    cap = max(1, math.ceil(k * source_cap))
    order = ["turn", "day", "__h"]
    rest = first_of_each(spread, ["source", "bucket", "has_media"], order, max(k, 1))
    rest = first_of_each(rest, ["bucket", "has_media"], order, max(1, math.ceil(k * (2 + 1 / source_cap))))

    def choose(t):
        t = t.sort_by([(c, "ascending") for c in order])
        rows = list(zip(*(t.column(c).to_pylist() for c in ("source", "bucket", "has_media"))))
        taken, sources, buckets, media = {}, Counter(), Counter(), 0
        for step in (1, 2, 3, 4):
            for i, (source, length, has_media) in enumerate(rows):
                if len(taken) >= k or step == 1 and media >= media_quota:
                    break
                if i in taken or step == 1 and not has_media or step < 4 and sources[source] >= cap or step == 2 and buckets[length] >= targets[length]:
                    continue
                taken[i] = (step, len(taken) + 1)
                sources[source] += 1
                buckets[length] += 1
                media += has_media
        out = t.take(pa.array(list(taken), pa.int64())).select(["post_id", "source", "bucket", "day", "has_media"])
        return (out.append_column("step", pa.array([s for s, _ in taken.values()], pa.int32())).append_column("place", pa.array([n for _, n in taken.values()], pa.int32())))

    kind = posts.schema["post_id"].dataType.simpleString()
    return rest.groupBy().applyInArrow(choose, f"post_id {kind}, source string, bucket string, day date, has_media boolean, step int, place int")


#: Upper bounds of price differences; larger ones are ``>10``.
PRICE_BANDS = [0.5, 1.0, 5.0, 10.0]


def price_band(gold: Column, pred: Column) -> Column:
    """Band of the distance of two prices; null unless both are numbers."""
    diff = F.abs(gold.try_cast("decimal(38,10)") - pred.try_cast("decimal(38,10)"))
    out = F.lit(">10")
    for limit in reversed(PRICE_BANDS):
        out = F.when(diff <= limit, f"<={limit:g}").otherwise(out)
    return F.when(diff.isNotNull(), out)


def run_stats(posts: DataFrame, drafts: DataFrame, confidence: str = "confidence") -> DataFrame:
    """(metric, value) of an extractor's run: posts with and without opinion or with several, drafts, unknown stances, confidences."""
    n = drafts.groupBy("post_id").agg(F.count(F.lit(1)).alias("n"))
    p = posts.select("post_id").join(n, "post_id", "left").agg(
        F.count(F.lit(1)).alias("posts"), F.count("n").alias("posts_with_opinion"), F.count_if(F.col("n").isNull()).alias("posts_without_opinion"), F.count_if(F.col("n") > 1).alias("posts_with_several"))
    c = F.col(confidence)
    d = drafts.agg(F.count(F.lit(1)).alias("drafts"), F.count_if(F.col("stance") == "UNKNOWN").alias("unknown_stance"), F.count_if(c.isNull()).alias("confidence_missing"),
                   F.count_if(~c.between(0, 1)).alias("confidence_invalid"))
    return p.crossJoin(d).unpivot([], [*p.columns, *d.columns], "metric", "value")  # one row each


def price_bands(cells: DataFrame, fields: list[str]) -> DataFrame:
    """Wrong prices by field and distance from the gold price."""
    band = price_band(F.col("gold"), F.col("pred"))
    return (cells.where(F.col("field").isin(fields) & (F.col("outcome") == "wrong")).withColumn("band", band).where("band is not null")
            .groupBy("field", "band").agg(F.count(F.lit(1)).alias("n")))


def stats_by_side(pairs: DataFrame, source: str | None = None) -> DataFrame:
    """Outcome counts by run side and field of aligned cells (post_id, field, gold, gold_source, left_outcome, right_outcome)."""
    p = pairs if source is None else pairs.where(F.col("gold_source") == source)
    long = p.unpivot(["field", "gold"], ["left_outcome", "right_outcome"], "side", "outcome")
    return long.groupBy(F.regexp_replace("side", "_outcome$", "").alias("side"), "field").agg(
        F.count(F.lit(1)).alias("cells"), F.count("gold").alias("gold_present"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])


def refusals(cells: DataFrame, layer: str, core: str) -> DataFrame:
    """Per layer: posts without any value, how often the core field refuses a direction, and values that nobody scored."""
    posts = cells.groupBy(layer, "post_id").agg(F.bool_or(F.col("pred").isNotNull()).alias("any"))
    empty = posts.groupBy(layer).agg(F.count(F.lit(1)).alias("posts"), F.count_if(~F.col("any")).alias("without_opinion"))
    given = (F.col("field") == core) & F.col("pred").isNotNull()
    extra = F.col("outcome") == "not_evaluated"
    rest = cells.groupBy(layer).agg(F.count_if(given).alias("directions"), F.count_if(given & (F.col("pred") == "UNKNOWN")).alias("refused"),
                                    F.count_if(extra).alias("unscored"), F.count_if(extra & F.col("pred").isNotNull()).alias("unscored_with_value"))
    return empty.join(rest, layer).withColumn("refusal_rate", F.try_divide(F.col("refused"), F.col("directions")))


def label_conflicts(rows: DataFrame, text: str, negative: Column, positive: Column, up: list[str], down: list[str]) -> DataFrame:
    """Rows whose label speaks against cue words in their text, with those cues. Labels stay as they are."""
    found = lambda cues: F.filter(F.array(*[F.when(F.contains(F.col(text), F.lit(c)), F.lit(c)) for c in cues]), lambda x: x.isNotNull())
    cues = F.when(negative, found(up)).when(positive, found(down))
    return rows.withColumn("cues", cues).where(F.size("cues") > 0)
