"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over hashed words is trained with numpy from texts confirmed as toxic and from
unlabelled texts. With class prior p the risk is p R+(toxic as 1) + max(0, Ru(0) - p R+(toxic as 0)):
unlabelled text counts as clean, corrected for the toxic share in it, and where the correction
would make the clean part negative the step goes the other way. Labels of clean texts only serve
to estimate the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kept import free
from .scratch import small_batches
from .textbytes import LOWER, PrefixHash, chunks, mix, word_bounds

FEATURES = 1 << 18
#: Bytes of the word beginnings that are features beside the words.
BEGINNINGS = (4, 5, 6)


@dataclass(frozen=True)
class Settings:
    #: Bounds of the training sample; everything is scored whatever they are.
    max_positive: int = 3000
    max_unlabelled: int = 9000
    #: Standard deviations by which a feature's count in toxic texts must exceed the expected one.
    least_z: float = 4.0
    least_precision: float = 0.6
    epochs: int = 500
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 7


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of the distinct words and word beginnings of each document.

    Words are runs of letters and digits, A-Z lower-cased; beginnings of 4 to 6 bytes stand for the
    families of inflected and compound words.
    """
    keep = LOWER[data]
    keep[~_CORE[data]] = 32
    start, end, doc = word_bounds(keep, offsets)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    hashes = PrefixHash(keep)
    found, where = [hashes.ranges(start, end)], [doc]
    for n in BEGINNINGS:
        long = end - start >= n
        found.append(mix(hashes.ranges(start[long], start[long] + n) + np.uint64(n)))
        where.append(doc[long])
    pair = np.unique((np.concatenate(where).astype(np.uint64) << np.uint64(18)) | (np.concatenate(found) >> np.uint64(46)))
    return (pair & np.uint64(FEATURES - 1)).astype(np.int32), (pair >> np.uint64(18)).astype(np.int64)


_CORE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in chunks(batch.column("text")):
            f, doc = word_features(data, offsets)
            cuts = np.cumsum(np.bincount(doc, minlength=j - i))[:-1]
            yield pa.RecordBatch.from_arrays([batch.column("kind").slice(i, j - i), pa.array(
                [x.astype("<i4").tobytes() for x in np.split(f, cuts)], pa.binary())], names=["kind", "f"])


def _counts(rows: list[np.ndarray]) -> np.ndarray:
    """Rows that have each feature; some rows at a time, as all at once would be copied."""
    total = np.zeros(FEATURES, dtype=np.int64)
    for s in range(0, len(rows), 256):
        total += np.bincount(np.concatenate(rows[s : s + 256]), minlength=FEATURES)
    return total


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, s: Settings) -> np.ndarray:
    """Weights, the last one being the bias."""
    rows = positive + unlabelled
    n_pos = len(positive)
    if not positive or not unlabelled:
        return np.array([*np.zeros(FEATURES), -4.0], dtype=np.float32)
    # Features that toxic texts have far more often than unlabelled ones; others would only be noise.
    is_pos = np.arange(len(rows)) < n_pos
    with_pos, with_un = _counts(positive), _counts(unlabelled)
    expected = with_un * (n_pos / len(unlabelled))
    telling = (with_pos - expected) / np.sqrt(expected + 1) >= s.least_z
    telling &= prior * with_pos >= s.least_precision * expected  # toxic texts among those that have it
    rows = [r[telling[r]] for r in rows]
    col, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, col = np.unique(col, return_inverse=True)
    w, b = np.zeros(len(used)), -1.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    n_un = len(rows) - n_pos
    for t in range(1, s.epochs + 1):
        z = np.bincount(row, weights=w[col], minlength=len(rows)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        soft = np.logaddexp(0, z)  # loss of calling a text clean
        clean = soft[~is_pos].mean() - prior * soft[is_pos].mean()
        if clean >= 0:
            g = np.where(is_pos, prior * ((p - 1) - p) / n_pos, p / n_un)
        else:  # the non-negative correction: undo what over-fitted
            g = np.where(is_pos, prior * p / n_pos, -p / n_un)
        gw = np.bincount(col, weights=g[row], minlength=len(used)) + s.decay * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= s.rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= s.rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    out = np.zeros(FEATURES + 1, dtype=np.float32)
    out[used], out[-1] = w, b
    return out


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> np.ndarray:
    """Weights from the rows that are not held out. Null labels are no labels; without toxic
    examples every text scores as clean."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("id")))
    share = marked.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    key = F.xxhash64(F.lit(settings.seed), F.col("id"))
    chosen = marked.where("y = 1").select("id").distinct().orderBy(key, "id").limit(settings.max_positive)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(~held_out(F.col("id")))
    n = texts.count()
    # A share of the hash range holds about the bounded number of rows; limit() bounds it in any case.
    part = min(1.0, settings.max_unlabelled / max(n, 1))
    other = texts.where(F.shiftrightunsigned(key, 11) < F.lit(part * 2**53)).limit(2 * settings.max_unlabelled)
    sample = (texts.join(F.broadcast(chosen), "id").select(F.lit(1).alias("kind"), "text").limit(2 * settings.max_positive)
              .unionByName(other.select(F.lit(0).alias("kind"), "text")))
    sets: dict[int, list[np.ndarray]] = {0: [], 1: []}
    # Bounded by the settings: sets of distinct words of the sampled texts.
    for r in sample.mapInArrow(_features, "kind int, f binary").toLocalIterator():
        sets[r.kind].append(np.frombuffer(r.f, dtype="<i4"))
    for k in sets:
        sets[k].sort(key=lambda x: (len(x), x.tobytes()))
    weights = fit_nnpu(sets[1], sets[0], min(max(share or 0.0, 1e-3), 0.999), settings)
    sets.clear()
    free()  # the sample would stay with the driver's allocator
    return weights


def _scores(weights, at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(at)):
                f, doc = word_features(data, offsets)
                z = np.bincount(doc, weights=w[f], minlength=j - i) + float(w[-1])
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=[*part.schema.names, "__score"])
    return run


def score_toxicity(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """All rows and columns of ``docs`` with ``score_col`` in [0, 1] added (replaced if there).

    Scores depend on the text alone. Null and empty texts, and texts without letters or digits, get
    the score of the prior; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB, fixed
    small_batches(docs.sparkSession)
    cols = [F.col(f"`{c}`") for c in docs.columns if c != score_col]
    schema = docs.select(*cols, F.lit(0.0).alias("__score")).schema
    return docs.select(*cols).mapInArrow(_scores(shared, text_col), schema).withColumnRenamed("__score", score_col)
