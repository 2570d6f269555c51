"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

The product is accumulated only where the sizes allow a link. With the columns of every row in one
common order, two rows that reach the threshold share a column among the first few of each (how
many follows from the row's size), and their sizes and places bound the overlap. Columns are
ordered from rare to frequent by a count sketch over all rows, which is made in the pass that digests the
sets; any one order is right, and this one keeps frequent n-grams from meeting. Rows with equal sets
are one row, so copies do not meet.

Linking needs no pair inside a group that is already connected. Round one compares each row with
one representative of the column's block and the representatives with each other, which joins the
groups of near copies; round two compares what shares a column across different groups, first each
row with the one whose signature is nearest, so that a group is joined by about as many pairs as it
has rows, then all that is still apart. Nothing is left out: blocks of rows of one column meet in a task, which discards pairs by bounds on
their overlap - sizes, places, and a parity signature of each row, in which every n-gram flips one
bit, so two sets differ in at least as many n-grams as their signatures in bits. What remains is
multiplied in blocks: the rows that meet one head are looked up in its column set entry by entry,
and the counts of n-grams that both have are accumulated per row and held against the size bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, release
from .skew import join_counted
from .textbytes import chunks, flat, mix, shingle_sets

#: Counters of the sketch (bounded, 1 MB) and their blocks.
SKETCH, SKETCH_BLOCK = 1 << 18, 1 << 14
#: Blocks into which the rows of one column are dealt for round one.
BLOCKS = 32
#: Rows of a column that meet in one task of round two; bits of a row's signature.
TILE, SIGNATURE = 1024, 1024
#: Pairs that are held against the bounds at once.
PAIRS = 1 << 16
#: Passes of round two that take only each row's nearest pair, before one that takes all.
SPARSE = 3
#: Rows of which late passes may broadcast the identifiers (16 bytes each).
FEW = 20_000
#: Rows that one copy of a head's set is multiplied with.
ROWS_OF_HEAD = 256
_NULL_ID = -(2**63)


def _slot(h: np.ndarray) -> np.ndarray:
    return (mix(h + np.uint64(1)) >> np.uint64(46)).astype(np.int64)


def _sets(k: int):
    """Rows (id, tk, n, d1, d2): size and two digests of each document's set; then the task's share of the count sketch, in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "tk", "n", "d1", "d2", "block", "counts"]
        sketch = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                h, doc = shingle_sets(data, offsets, k)
                sketch += np.bincount(_slot(h), minlength=SKETCH)
                n = np.bincount(doc, minlength=j - i)
                digests = []
                for salt in (0x1234567, 0x89ABCDE):  # sums over the set, so order does not matter
                    total = np.zeros(len(h) + 1, dtype=np.uint64)
                    np.cumsum(mix(h ^ np.uint64(salt)), out=total[1:])
                    ends = np.cumsum(n)
                    digests.append(pa.array((total[ends] - total[ends - n]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), batch.column("tk").slice(i, j - i), pa.array(n.astype(np.int32)),
                                                  *digests, pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.binary())], names=names)
        held = np.flatnonzero(sketch.reshape(-1, SKETCH_BLOCK).any(axis=1))
        counts = [np.minimum(sketch[b * SKETCH_BLOCK : (b + 1) * SKETCH_BLOCK], 2**31 - 1).astype("<i4").tobytes() for b in held]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(held), t) for t in kinds], pa.array(held.astype(np.int32)), pa.array(counts, pa.binary())], names=names)
    return run


def _add_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, "<i4").astype(np.int64) for c in pdf["counts"])
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "counts": [np.minimum(total, 2**31 - 1).astype("<i4").tobytes()]})


def _summed(shares: DataFrame) -> DataFrame:
    """Block sums by a tree: a task adds about the square root of all shares of a block."""
    n = max(1, int(shares.select("task").distinct().count() ** 0.5))
    kinds = "block int, counts binary"
    some = shares.groupBy("block", F.pmod("task", F.lit(n))).applyInPandas(lambda key, pdf: _add_blocks(pdf), kinds)
    return some.groupBy("block").applyInPandas(_add_blocks, kinds)


def _prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _prefixes(k: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                h, doc = shingle_sets(data, offsets, k)
                # Sets come sorted by hash, so a stable sort by document and count keeps that as the last key.
                order = np.argsort(doc.astype(np.uint64) << np.uint64(32) | sketch[_slot(h)].astype(np.uint64), kind="stable")
                h = h[order]
                n = np.bincount(doc, minlength=j - i)
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                length = np.where(n > 0, _prefix_length(n, percent), 0)
                first = h[place < np.repeat(length, n)]
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                flips = np.bincount(np.repeat(np.arange(j - i), n) * SIGNATURE + (mix(h ^ np.uint64(0xABCDEF)) % np.uint64(SIGNATURE)).astype(np.int64),
                                    minlength=(j - i) * SIGNATURE).reshape(j - i, SIGNATURE) & 1
                packed = np.packbits(flips.astype(np.uint8), axis=1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(i, j - i), batch.column("tk").slice(i, j - i), pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(first.view(np.int64))), pa.array([r.tobytes() for r in packed], pa.binary())],
                    names=["id", "tk", "n", "grams", "signature"])
    return run


def _near(percent: int):
    """Pairs whose parity signatures leave room for the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            n = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            apart = np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64)
            keep = pa.array((100 + percent) * apart <= (100 - percent) * n.astype(np.int64))
            yield batch.select(["a", "ta", "b", "tb"]).filter(keep)
    return run


def _overlaps(k: int, percent: int):
    """Blocks of rows times the column of their head: each entry (row, n-gram) of the block that the
    head has too adds one to its row's count; rows below the bound are discarded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, key = np.zeros(0, np.uint64), None  # rows are sorted by head, with the head's own text first
        for batch in batches:
            heads = np.stack([batch.column(c).to_numpy() for c in ("a", "ta", "part")], axis=1)
            side, ids = batch.column("side").to_numpy(), batch.column("b").to_numpy()
            out: list[np.ndarray] = []
            for i, j, data, offsets in chunks(batch.column("text")):
                h, doc = shingle_sets(data, offsets, k)
                n = np.bincount(doc, minlength=j - i)
                ends = np.cumsum(n)
                cuts = [0, *(np.flatnonzero((heads[i + 1 : j] != heads[i : j - 1]).any(axis=1)) + 1).tolist(), j - i]
                for s, e in zip(cuts, cuts[1:]):
                    if key is None or (heads[i + s] != key).any():
                        key, head = heads[i + s], h[ends[s] - n[s] : ends[s]].copy()
                    block = slice(ends[s] - n[s], ends[e - 1])
                    at = np.minimum(np.searchsorted(head, h[block]), len(head) - 1)
                    both = np.bincount(doc[block][head[at] == h[block]] - s, minlength=e - s)
                    fine = (side[i + s : i + e] == 1) & (both > 0) & (100 * both >= percent * (len(head) + n[s:e] - both))
                    hit = np.flatnonzero(fine)
                    out.append(np.stack([np.full(len(hit), key[0]), ids[i + s + hit], both[hit]]))
            a, b, both = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(both, pa.int64())], names=["a", "b", "overlap"])
    return run


def _survivors(percent: int, nearest: bool):
    """Rows sorted by column, tiles and half -> pairs of different groups that no bound discards.

    With ``nearest`` each row gets only the pair whose signatures differ least, so there are never
    more pairs than rows; columns in which that leaves pairs out follow as rows of their own.
    """
    def pairs(n, place, g, sig, lo, hi) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ends = np.concatenate([[0], np.cumsum(hi - lo)])
        s = 0
        while s < len(n):
            e = max(s + 1, int(np.searchsorted(ends, ends[s] + PAIRS, "right")) - 1)
            i = np.repeat(np.arange(s, e), (hi - lo)[s:e])
            j = np.arange(len(i)) - np.repeat(ends[s:e] - ends[s] - lo[s:e], (hi - lo)[s:e])
            fine = g[i] != g[j]
            i, j = i[fine], j[fine]
            total = n[i] + n[j]
            fine = (100 + percent) * np.minimum((n - place)[i], (n - place)[j]) >= percent * total
            fine &= np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
            i, j, total = i[fine], j[fine], total[fine]
            apart = np.bitwise_count(sig[i] ^ sig[j]).sum(axis=1).astype(np.int64)
            near = (100 + percent) * apart <= (100 - percent) * total
            yield i[near], j[near], apart[near]
            s = e

    def solve(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        gram, x, y, half, ids, keys, n, place, g = (batch.column(c).to_numpy().astype(np.int64) for c in ("gram", "x", "y", "half", "id", "tk", "n", "place", "g"))
        sig = flat(batch.column("signature"))[0].view(np.uint64).reshape(len(n), -1)
        at = np.arange(len(n))
        tile = np.concatenate([[0], np.cumsum((gram[1:] != gram[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))])
        hi = np.searchsorted(tile, tile, "right")
        # In one tile a row meets those behind it; of two tiles, the rows of the first meet the second.
        lo = np.where(x == y, at + 1, np.where(half == 0, np.searchsorted(2 * tile + half, 2 * tile + 1), hi))
        more = []
        for i, j, apart in pairs(n, place, g, sig, lo, hi):
            if nearest and len(i):
                order = np.lexsort((apart, i))
                first = np.ones(len(i), dtype=bool)
                first[1:] = i[order][1:] != i[order][:-1]
                more.append(gram[i[order][~first]])
                i, j = i[order][first], j[order][first]
            swap = (ids[i] > ids[j]) | ((ids[i] == ids[j]) & (keys[i] > keys[j]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            yield pa.RecordBatch.from_arrays([*map(pa.array, (ids[i], keys[i], ids[j], keys[j])), pa.nulls(len(i), pa.int64())], names=["a", "ta", "b", "tb", "more"])
        left = np.unique(np.concatenate(more)) if more else gram[:0]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(left), pa.int64())] * 4, pa.array(left)], names=["a", "ta", "b", "tb", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        joined = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("gram", "x", "y")], axis=1)
            # Rows up to the last tile's first one hold whole tiles.
            other = np.flatnonzero((key != key[-1]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and (cut or [held[-1].column(c)[-1].as_py() for c in ("gram", "x", "y")] != key[-1].tolist()):
                held += [batch.slice(0, cut)] if cut else []
                yield from solve(joined())
                held = []
            elif cut:
                yield from solve(batch.slice(0, cut))
            held.append(batch.slice(cut))
        if held:
            yield from solve(joined())
    return run


class _Join:
    def __init__(self, texts: DataFrame, signatures: DataFrame, scratch: Scratch, k: int, percent: int):
        self.texts, self.signatures, self.scratch, self.k, self.percent = texts, signatures, scratch, k, percent

    def near(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, ta, b, tb) of row keys, distinct -> those that the signatures do not discard."""
        end = lambda i, t, n, s: self.signatures.select(F.col("id").alias(i), F.col("tk").alias(t), F.col("n").alias(n), F.col("signature").alias(s))
        both = pairs.join(end("a", "ta", "n", "sa"), ["a", "ta"]).join(end("b", "tb", "m", "sb"), ["b", "tb"])
        return both.select("a", "ta", "b", "tb", "n", "m", "sa", "sb").mapInArrow(_near(self.percent), "a bigint, ta bigint, b bigint, tb bigint")

    def links(self, pairs: DataFrame, name: str, late: bool = False) -> DataFrame:
        """pairs (a, ta, b, tb) of row keys, distinct -> (a, b, overlap) of those that link.

        ``a`` is the head: its set is sent once for up to ROWS_OF_HEAD rows that are multiplied with it.
        ``late`` passes have few pairs: then only the texts that they name are shuffled.
        """
        n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        heads = pairs.groupBy("a", "ta").agg(F.ceil(F.count(F.lit(1)) / ROWS_OF_HEAD).cast("int").alias("parts"))
        own = heads.select(F.col("a").alias("id"), F.col("ta").alias("tk"), "a", "ta", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"))
        total = pairs.count()
        rows = join_counted(pairs, pairs.groupBy("a", "ta").agg(F.count(F.lit(1)).alias("rows")), ["a", "ta"], "rows", total)
        rows = rows.select(F.col("b").alias("id"), F.col("tb").alias("tk"), "a", "ta",
                           F.pmod(F.xxhash64("b", "tb"), F.ceil(F.col("rows") / ROWS_OF_HEAD)).cast("int").alias("part"), F.lit(1).alias("side"))
        need = own.unionByName(rows)
        texts, ids = self.texts, need.select("id", "tk").distinct()
        if late and 2 * total <= FEW:
            texts = texts.join(F.broadcast(ids), ["id", "tk"], "left_semi")
        met = (texts.join(need.hint("shuffle_hash"), ["id", "tk"]).select("a", "ta", "part", "side", F.col("id").alias("b"), "text")
               .repartition(n, "a", "ta", "part").sortWithinPartitions("a", "ta", "part", "side"))
        found = self.scratch.save(met.mapInArrow(_overlaps(self.k, self.percent), "a bigint, b bigint, overlap bigint"), name)
        release(pairs.sparkSession)
        return found


def _tiles(e: DataFrame, signatures: DataFrame) -> DataFrame:
    """Large columns are cut into tiles by hash; a task gets two tiles of one column, or one."""
    m = F.ceil(F.col("m") / TILE)
    e = e.join(e.groupBy("gram").agg(F.count(F.lit(1)).alias("m")), "gram").join(signatures.select("id", "tk", "signature"), ["id", "tk"]).withColumn("tile", F.pmod(F.xxhash64("id", "tk"), m))
    return e.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), m - 1))).select(
        "gram", F.least("tile", "o").alias("x"), F.greatest("tile", "o").alias("y"), (F.col("tile") > F.col("o")).cast("int").alias("half"), "id", "tk", "n", "place", "g", "signature")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept.

    Words are runs without white space, A-Z lower-cased. A document's set holds its distinct
    ``k``-word shingles; with fewer words, its whole sequence; without words or text, nothing, and
    then it links with nothing. Documents link if 100 * intersection >= percent * union.
    ``component_id`` is the smallest id_col reachable; ``kept`` marks the row that has it (of rows
    that repeat identifier and component all are marked). Rows that share an identifier are one
    document for reachability. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tk", F.xxhash64("text"))
    made = texts.mapInArrow(_sets(k), "id bigint, tk bigint, n int, d1 bigint, d2 bigint, block int, counts binary").withColumn("task", F.spark_partition_id())
    made = scratch.save(made, "sets", compression="zstd")
    sets, shares = made.where("block is null").select("id", "tk", "n", "d1", "d2"), made.where("block is not null").select("block", "counts", "task")

    # Equal sets are one row of the matrix, under its smallest identifier.
    classes = scratch.save(sets.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct("id", "tk")).alias("r"))
                           .select("d1", "d2", "n", F.col("r.id").alias("rep"), F.col("r.tk").alias("rtk")), "classes")
    one = classes.select(F.col("rep").alias("id"), F.col("rtk").alias("tk"))
    texts = scratch.save(texts.join(one.hint("shuffle_hash"), ["id", "tk"], "left_semi"), "texts", compression="zstd")
    release(spark)
    sketch = np.zeros(SKETCH, dtype=np.int32)
    # At most SKETCH / SKETCH_BLOCK rows of 64 KB, however many documents there are.
    for r in _summed(shares).collect():
        sketch[r.block * SKETCH_BLOCK : (r.block + 1) * SKETCH_BLOCK] = np.frombuffer(r.counts, "<i4")
    shared = spark.sparkContext.broadcast(sketch)
    rows = scratch.save(texts.mapInArrow(_prefixes(k, percent, shared), "id bigint, tk bigint, n int, grams array<bigint>, signature binary")
                        .dropDuplicates(["id", "tk"]), "rows")
    release(spark)
    grams = rows.select("id", "tk", "n", F.posexplode("grams").alias("place", "gram"))
    frequent = scratch.save(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "frequent")
    entries = scratch.save(join_counted(grams, frequent, ["gram"], "c", grams.count()).drop("c"), "entries")
    signatures = scratch.save(rows.select("id", "tk", "n", "signature"), "signatures")
    scratch.drop("rows", "frequent")
    release(spark)

    # Round one: a row with the representative of its block, representatives with each other.
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    e = entries.withColumn("block", F.pmod(F.xxhash64("id", "tk"), F.lit(BLOCKS)))
    heads = scratch.save(e.groupBy("gram", "block").agg(F.min(F.struct("id", "tk", "n")).alias("h")), "heads")
    tops = heads.groupBy("gram").agg(F.min("h").alias("t"))
    spokes = e.join(heads, ["gram", "block"]).select("id", "tk", "n", F.col("h.id").alias("i2"), F.col("h.tk").alias("t2"), F.col("h.n").alias("m"))
    hubs = heads.join(tops, "gram").select(F.col("h.id").alias("id"), F.col("h.tk").alias("tk"), F.col("h.n").alias("n"),
                                           F.col("t.id").alias("i2"), F.col("t.tk").alias("t2"), F.col("t.n").alias("m"))
    one = spokes.unionByName(hubs).where("id <> i2 or tk <> t2").where(fits)
    ordered = [F.least(F.struct("id", "tk"), F.struct(F.col("i2").alias("id"), F.col("t2").alias("tk"))).alias("x"),
               F.greatest(F.struct("id", "tk"), F.struct(F.col("i2").alias("id"), F.col("t2").alias("tk"))).alias("y")]
    keys = [F.col("x.id").alias("a"), F.col("x.tk").alias("ta"), F.col("y.id").alias("b"), F.col("y.tk").alias("tb")]
    join = _Join(texts, signatures, scratch, k, percent)
    tried = scratch.save(one.select(*ordered).select(*keys).distinct(), "tried")
    scratch.drop("heads")
    release(spark)
    first = join.links(scratch.save(join.near(tried), "near1"), "links1")
    groups = connected_components(first)

    # Round two: all else that shares a column across different groups. Passes that take each row's
    # nearest pair join large groups in a number of pairs that follows from their rows; the columns
    # in which they left pairs out go on, with the groups known by then.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = first.select("a", "b")
    e, nearest = entries, True
    for turn in range(SPARSE + 1):
        e = e.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("g", F.coalesce("component", "id")).drop("component")
        torn = e.groupBy("gram").agg((F.min("g") != F.max("g")).alias("torn")).where("torn").select("gram")
        e = scratch.save(e.join(torn, "gram"), f"torn{turn}")
        found = scratch.save(_tiles(e, signatures).repartition(parts, "gram", "x", "y").sortWithinPartitions("gram", "x", "y", "half")
                             .mapInArrow(_survivors(percent, nearest), "a bigint, ta bigint, b bigint, tb bigint, more bigint"), f"found{turn}")
        scratch.drop(*(["entries"] if turn == 0 else [f"torn{turn - 1}", f"found{turn - 1}"]))
        release(spark)
        two = scratch.save(found.where("a is not null").drop("more").distinct().join(tried, ["a", "ta", "b", "tb"], "left_anti"), f"near2-{turn}")
        linked = not two.isEmpty()
        if linked:
            fresh = join.links(two, f"links2-{turn}", late=turn > 0).select("a", "b")
            linked = not fresh.isEmpty()
            tried = tried.unionByName(two)
        if linked:
            links = links.unionByName(fresh)
            groups = connected_components(links)
        left = found.where("more is not null").select(F.col("more").alias("gram")).distinct()
        if not nearest or left.isEmpty():
            break
        nearest = linked and turn + 1 < SPARSE
        e = e.drop("g").join(left, "gram")
    scratch.drop("texts", "signatures", "tried", "near1", f"torn{turn}", f"found{turn}", *(f"near2-{t}" for t in range(turn + 1)))
    shared.unpersist()

    named = classes.join(groups, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.col("n").alias("m"), "rep", F.coalesce("component", "rep").alias("component"))
    out = sets.join(named, (sets.d1 == named.d1) & (sets.d2 == named.d2) & (F.col("n") == F.col("m")), "left").select(
        "id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("c"))
    real = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return out.select(real("id").alias(id_col), "n_shingles", real("c").alias("component_id"), (F.col("id") == F.col("c")).alias("kept"))
