"""Near-duplicate embeddings by sorted projection passes.

A pass hashes every vector by the signs of some random projections and puts the vectors in the
lexicographic order of the concatenated hashes. A vector is compared in double precision with its
neighbours in that order: with a bounded window of others, and with the whole run of vectors whose
hashes are all equal, however long it is; a run longer than a block is cut into blocks, which meet
pairwise in tasks of their own, so that no follower is refused. A pair agrees on a sign with a
probability that its own angle gives, so the number of passes follows from the number of signs and
a pair at the threshold falls into one run with the wanted probability, however the other vectors
lie; what the windows find comes on top. Links of all passes are united. Equal vectors are one vector
with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, cut

_NULL_ID = -(2**63)
_LINK = "a bigint, b bigint, cosine double, beside boolean"
_BUCKET = ["turn", "dim", "code"]


def passes_for(signs: int, threshold: float, wanted: float = 0.999) -> int:
    """Passes so that a pair of cosine ``threshold`` shares a bucket of one with probability ``wanted``."""
    meet = (1 - math.acos(threshold) / math.pi) ** signs
    return 1 if meet >= wanted else math.ceil(math.log(1 - wanted) / math.log(1 - meet))


def signs_for(classes: DataFrame, n: int, window: int, threshold: float, sample: int = 1024) -> int:
    """The number of signs with the least work, by the angles between about ``sample`` of the ``n`` vectors.

    Two vectors share a bucket of k signs with probability (1 - angle / pi) ** k, so the sample's
    mean of that is the share of all pairs that a pass compares, also where many vectors crowd into
    one cone. Carrying a row through a pass counts as much as 8 * window comparisons. The sample
    decides the work only, and a small table has few signs by the same rule.
    """
    places = 1 << 30
    most = min(places, max(1, places * sample // max(n, 1)))
    drawn = classes.where(F.pmod(F.xxhash64("id"), F.lit(places)) < most).select("vec").toArrow().column("vec").combine_chunks()
    dims = pc.list_value_length(drawn).to_numpy()
    agree = []
    for d in np.unique(dims).tolist():
        x = _unit(drawn.take(pa.array(np.flatnonzero(dims == d))).flatten().to_numpy().astype(np.float64).reshape(-1, d))
        angle = np.arccos(np.clip(x @ x.T, -1, 1))
        agree.append(1 - angle[np.triu_indices(len(x), 1)] / math.pi)
    agree, pairs = np.concatenate([*agree, np.zeros(0)]), max(1, len(dims) * (len(dims) - 1) // 2)
    work = [passes_for(k, threshold) * (n * float((agree**k).sum()) / pairs / 2 + 8 * window) for k in range(1, 31)]
    return 1 + int(np.argmin(work))


def _codes(signs: int, passes: int, seed: int):
    """(id, vec) -> (id, dim, vec, codes): the signs of each pass as a number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, column = batch.column("id"), batch.column("vec")
            dims = pc.list_value_length(column).to_numpy()
            for d in np.unique(dims).tolist():
                row = np.flatnonzero(dims == d)
                if d not in planes:
                    planes[d] = np.random.Generator(np.random.PCG64([seed, d])).standard_normal((d, passes * signs))
                for s in range(0, len(row), 1024):
                    part = pa.array(row[s : s + 1024])
                    n, vec = len(part), column.take(part)
                    x = _unit(vec.flatten().to_numpy().astype(np.float64).reshape(n, d))
                    codes = (x @ planes[d] > 0).reshape(n, passes, signs) @ (np.int64(1) << np.arange(signs, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([
                        ids.take(part), pa.array(np.full(n, d, np.int32)), vec,
                        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * passes, pa.array(codes.astype(np.int32).ravel()))],
                        names=["id", "dim", "vec", "codes"])
    return run


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs(left: tuple, right: tuple | None, turn: int, threshold: float, beside: bool = False) -> Iterator[pa.RecordBatch]:
    """Links between two sets of (ids, unit vectors, codes), or inside one, that no earlier pass has met.

    Those of neighbours ``beside`` each other count only if no pass has them in one run.
    """
    ids, x, codes = left
    other_ids, y, other_codes = right or left
    for s in range(0, len(ids), 256):
        lo = 0 if right else s
        cosine = x[s : s + 256] @ y[lo:].T
        r, c = np.nonzero(cosine >= threshold)
        if not right:
            r, c = r[c > r], c[c > r]
        cos, r, c = cosine[r, c], r + s, c + lo
        new = np.ones(len(r), bool)
        for t in range(codes.shape[1] if beside else turn):
            new &= codes[r, t] != other_codes[c, t]
        if new.any():
            a, b = ids[r[new]], other_ids[c[new]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cos[new]), pa.array(np.full(len(a), beside))],
                                             names=["a", "b", "cosine", "beside"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted rows -> (turn, dim, code, piece, pieces, ids, vectors, codes) of each whole piece."""
    def solve(t):
        t = t.combine_chunks()
        turn, dim, code, piece, pieces = (t.column(k)[0].as_py() for k in [*_BUCKET, "piece", "pieces"])
        flat = lambda k: t.column(k).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        return turn, dim, code, piece, pieces, t.column("id").to_numpy(), flat("vec").astype(np.float64), flat("codes")

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        key = np.stack([held.column(k).to_numpy() for k in [*_BUCKET, "piece"]])
        edges = [0, *(np.flatnonzero((np.diff(key) != 0).any(axis=0)) + 1).tolist()]
        for i, j in zip(edges, edges[1:]):
            yield solve(held.slice(i, j - i))
        held = held.slice(edges[-1])
    if held is not None and held.num_rows:
        yield solve(held)


def _whole(threshold: float, window: int):
    """Sorted runs of one block at most: links inside each, and with the window of vectors before it in the order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, before = None, None
        for turn, dim, _, _, _, ids, x, codes in _pieces(batches):
            rows = ids, _unit(x), codes
            if len(ids) > 1:
                yield from _pairs(rows, None, turn, threshold)
            if order != (turn, dim):
                order, before = (turn, dim), None
            if before is not None:
                yield from _pairs(before, tuple(v[:window] for v in rows), turn, threshold, beside=True)
                rows = tuple(np.concatenate([u[-window:], v[-window:]]) for u, v in zip(before, rows))
            before = tuple(v[-window:] for v in rows)
    return run


_PACKED = "turn int, dim int, code int, piece int, pieces int, ids binary, vecs binary, codes binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of large buckets as one row each; components are single precision where that is all they hold."""
    for turn, dim, code, piece, pieces, ids, x, codes in _pieces(batches):
        with np.errstate(over="ignore"):
            short = x.astype(np.float32)
        x = short if (short == x).all() else x
        yield pa.RecordBatch.from_arrays([
            *[pa.array([v], pa.int32()) for v in (turn, dim, code, piece, pieces)],
            *[pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (ids, x, codes)]],
            names=["turn", "dim", "code", "piece", "pieces", "ids", "vecs", "codes"])


def _stripes(threshold: float):
    """Rows of a stripe, sorted by step: its own piece first, then those that it is compared with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                turn, dim, code, stripe, step, ids, vecs, codes = (
                    batch.column(k)[i].as_py() for k in [*_BUCKET, "stripe", "step", "ids", "vecs", "codes"])
                ids = np.frombuffer(ids, np.int64)
                x = np.frombuffer(vecs, np.float32 if len(vecs) == 4 * dim * len(ids) else np.float64).reshape(len(ids), dim)
                rows = ids, _unit(x.astype(np.float64)), np.frombuffer(codes, np.int32).reshape(len(ids), -1)
                if step == 0:
                    own, mine = (turn, dim, code, stripe), rows
                    yield from _pairs(mine, None, turn, threshold)
                elif own == (turn, dim, code, stripe):
                    yield from _pairs(mine, rows, turn, threshold)
    return run


def _compare(coded: DataFrame, window: int, block: int, threshold: float, parts: int) -> DataFrame:
    """Every link of some pass: once if a run holds it, else once for each window that does."""
    rows = coded.select("id", "dim", "vec", "codes", F.posexplode("codes").alias("turn", "code"))
    large = rows.groupBy(*_BUCKET).count().where(F.col("count") > block)
    rows = (rows.join(large, _BUCKET, "left")  # its size is for Spark to weigh: broadcast or shuffled
            .withColumn("pieces", F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int"))
            .withColumn("piece", F.pmod(F.xxhash64("turn", "id"), F.col("pieces")).cast("int")).drop("count"))
    deal = lambda df: df.repartition(parts, *_BUCKET, "piece").sortWithinPartitions(*_BUCKET, "piece")
    order = rows.where("pieces = 1").repartitionByRange(parts, *_BUCKET).sortWithinPartitions(*_BUCKET)
    small = order.mapInArrow(_whole(threshold, window), _LINK)
    packed = deal(rows.where("pieces > 1")).mapInArrow(_pack, _PACKED)
    # Each piece meets the half of the others that follows it in a circle, so stripes are equally long.
    met = (packed.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("pieces") / 2).cast("int"))).alias("step"))
           .withColumn("stripe", F.pmod(F.col("piece") - F.col("step"), F.col("pieces")))
           .where("step * 2 < pieces or stripe * 2 < pieces"))
    striped = met.repartition(parts, *_BUCKET, "stripe").sortWithinPartitions(*_BUCKET, "stripe", "step")
    return small.unionByName(striped.mapInArrow(_stripes(threshold), _LINK))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, window: int = 64, block: int = 4096, seed: int = 11,
                    id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows, links). rows: id_col, n_links, component_id, kept, one for each vector; links: (a, b,
    cosine) between representatives of equal vectors.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as
    do vectors of different length; equal vectors link. ``n_links`` counts other rows linked
    directly; ``component_id`` is the smallest id_col reachable. Rows that share an identifier are
    one node. An empty table gives no rows; other columns are not read. ``window`` bounds the
    neighbours of other hashes on each side; runs of equal hashes are compared whole, in pieces of about ``block`` vectors.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    sound = F.coalesce((F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
                       & F.exists("vec", lambda x: x != 0), F.lit(False))
    v = v.withColumn("vec", F.when(sound, F.transform("vec", lambda x: x + F.lit(0.0))))
    classes = scratch.save(v.where("vec is not null").groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("c")), "classes")
    n = classes.count()
    signs = signs_for(classes, n, 256, threshold)
    coded = scratch.save(classes.select("id", "vec").mapInArrow(_codes(signs, passes_for(signs, threshold), seed),
                                                               "id bigint, dim int, vec array<double>, codes array<int>"), "coded")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = scratch.save(_compare(coded, window, block, threshold, parts), "met")
    scratch.drop("coded")
    links = met.where("not beside").drop("beside").unionByName(met.where("beside").dropDuplicates(["a", "b"]).drop("beside"))
    groups = connected_components(links)
    size = classes.select("id", "c")
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    degree = (ends.join(size.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("c").alias("others")))
    named = (classes.join(groups, F.col("id") == F.col("node"), "left").join(degree, F.col("id") == F.col("a"), "left")
             .select(F.col("vec").alias("vec"), F.coalesce("component", "id").alias("component"),
                     (F.col("c") - 1 + F.coalesce("others", F.lit(0))).alias("links")))
    named = cut(named)
    out = v.join(named, "vec", "left").select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("c"))
    real = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return out.select(real("id").alias(id_col), "n_links", real("c").alias("component_id"), (F.col("id") == F.col("c")).alias("kept")), links
