"""Phrase collocations: every phrase of two to four words that occurs often enough, scored per language.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into
words. Phrases are counted in two steps:

* *Summaries.* Hashes of n-grams are dealt to hash partitions, whose number follows the size of the input.
  Each task sends a partition one summary, the hashes it met with their counts. A partition knows its mass, the
  sum of all counts, and merges its summaries Misra-Gries fashion into at most ``mass / threshold + 1``
  counters: what is subtracted from any counter stays below the threshold, so every frequent n-gram survives.
  The summaries are then read again and the survivors counted exactly.
* *Exact counts.* Survivors set a bit in a bitmap of fixed size. The texts are read a last time; n-grams whose
  bits are set are counted by their words, not by hashes. A wrong bit costs a count that is dropped later,
  never a phrase, so the bitmap may fill up without changing any result.

Words and pairs are summarised first; triples and quadruples only where all pairs inside them are set, as no
phrase is more frequent than its parts. A document is hashed whole, in one task, at some dozens of bytes of
memory for each of its own. A task tells the phrases it holds apart by 64-bit hashes; across tasks their words do.

Null texts are empty, a null language is ``und``; rows without words add nothing, and a table without rows
gives none. Repeated rows count as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, release
from .textbytes import LOWER, PrefixHash, chunks, mix

#: Bytes of text for each hash partition: a summary entry takes 4 to 8 bytes, and there are at most 1.5 for a byte of text.
PART_BYTES = 6_000_000
#: Bits of the bitmap of survivors, a power of two.
BITMAP_BITS = 1 << 26
#: N-grams that a task holds before it sums them up.
HELD = 2_000_000
LONGEST = 4
#: Words that a task counts before it passes its counts on; this bounds the phrases that it holds.
TALLIED = 600_000
#: Bytes of the bitmap in a row.
BLOCK = 1 << 16

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True


class Words:
    """The words of a run of documents: bounds, piece numbers, languages and n-gram hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray):
        self.data = LOWER[data]
        word = ~_GAP[self.data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        doc = np.searchsorted(offsets, self.start, "right") - 1
        breaks = np.cumsum(_BREAK[self.data])[self.start] if len(data) else self.start
        self.piece = breaks + doc  # both grow with the position, so equal sums are equal pairs
        self.lang = lang[doc]
        self.grams = {1: mix(PrefixHash(self.data).ranges(self.start, self.end) ^ mix(self.lang.astype(np.uint64)))} if len(self.start) else {1: np.zeros(0, np.uint64)}

    def hashes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of the phrases of ``n`` words that lie in one piece."""
        for k in range(2, n + 1):
            if k not in self.grams:
                before = self.grams[k - 1]
                self.grams[k] = mix(before[:-1] * np.uint64(0x9DDFEA08EB382D69) + self.grams[1][k - 1 :] + np.uint64(k)) if len(before) else before
        at = np.flatnonzero(self.piece[: len(self.grams[n])] == self.piece[n - 1 :]) if len(self.grams[n]) else np.zeros(0, np.int64)
        return self.grams[n][at], at

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(at, at + n))


def _lang_code(name: str) -> int:
    """A number of a language, the same in every task; names that collide are told apart in the exact counts."""
    code = np.uint64(len(name))
    with np.errstate(over="ignore"):
        for byte in name.encode():
            code = mix(np.array([code * np.uint64(257) + np.uint64(byte)]))[0]
    return int(code)


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray]]:
    """The words of each chunk of documents and, for each document, its language's name."""
    for batch in rows:
        names = batch.column("lang").dictionary_encode()
        known = names.dictionary.to_pylist()
        codes = np.array([_lang_code(x) for x in known] or [0], dtype=np.uint64)
        index = names.indices.to_numpy(zero_copy_only=False)
        for i, j, data, offsets in chunks(batch.column("text")):
            yield Words(data, offsets, codes[index[i:j]]), dict(zip(codes.tolist(), known))


def has_bit(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _allowed(words: Words, n: int, bitmap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of ``n`` words all of whose pairs are set, or all where there is no bitmap yet."""
    h, at = words.hashes(n)
    if bitmap is None or n < 3:
        return h, at
    fine = has_bit(bitmap, words.hashes(2)[0])
    pairs = np.zeros(len(words.start), dtype=bool)
    pairs[words.hashes(2)[1][fine]] = True
    good = np.logical_and.reduce([pairs[at + i] for i in range(n - 1)])
    return h[good], at[good]


def summed(h: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and their counts."""
    if not len(h):
        return h, np.zeros(0, np.int64)
    if counts is None:
        h = np.sort(h)
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return h[first], np.diff(np.r_[first, len(h)])
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], np.add.reduceat(counts[order], first)


def misra_gries(summaries: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge summaries into at most ``capacity`` counters.

    Where more are left, all lose the count of the largest that must go; so each loss of one is shared by
    more than ``capacity`` counters, and no key loses more than ``mass / (capacity + 1)`` in all.
    """
    keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    waiting, size = [], 0

    def merge() -> tuple[np.ndarray, np.ndarray]:
        k, c = summed(np.concatenate([keys, *[x for x, _ in waiting]]), np.concatenate([counts, *[y for _, y in waiting]]))
        if len(k) > capacity:
            c = c - np.partition(c, len(c) - capacity - 1)[len(c) - capacity - 1]
            k, c = k[c > 0], c[c > 0]
        return k, c

    for one in summaries:
        waiting.append(one)
        size += len(one[0])
        if size > capacity:
            keys, counts = merge()
            waiting, size = [], 0
    return merge()


def _summaries(sizes: tuple[int, ...], parts: int, bitmap) -> Callable:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, dtype=np.uint8)
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h, counts = summed(np.concatenate(held) if held else np.zeros(0, np.uint64))
            held.clear()
            part = (h >> np.uint64(32)) % np.uint64(parts)
            once = counts == 1
            columns: dict[str, list] = {"part": [], "mass": [], "once": [], "more": [], "counts": []}
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edges)):
                rows_of = order[edges[p] : edges[p + 1]]
                single, multi = rows_of[once[rows_of]], rows_of[~once[rows_of]]
                columns["part"].append(int(p))
                columns["mass"].append(int(counts[rows_of].sum()))
                columns["once"].append(h[single].astype(np.uint32).tobytes())
                columns["more"].append(h[multi].astype(np.uint32).tobytes())
                columns["counts"].append(counts[multi].tobytes())
            return pa.record_batch([pa.array(columns["part"], pa.int32()), pa.array(columns["mass"], pa.int64()),
                                    *[pa.array(columns[c], pa.binary()) for c in ("once", "more", "counts")]], names=list(columns))

        for words, _ in _batches(rows):
            held += [_allowed(words, n, bits)[0] for n in sizes]
            if sum(map(len, held)) >= HELD:
                yield flush()
        yield flush()

    return run


def _survivors(threshold: int, parts: int, bitmap_bits: int) -> Callable:
    """For each hash partition, the bytes of the bitmap that its frequent hashes set."""

    def settle(part: int, blobs: list[tuple[int, bytes, bytes, bytes]]) -> np.ndarray:
        summaries = []
        for _, once, more, counts in blobs:
            a, b = np.frombuffer(once, np.uint32), np.frombuffer(more, np.uint32)
            summaries.append((np.concatenate([a, b]), np.concatenate([np.ones(len(a), np.int64), np.frombuffer(counts, np.int64)])))
        keys, _ = misra_gries(summaries, sum(b[0] for b in blobs) // threshold + 1)
        exact = np.zeros(len(keys), dtype=np.int64)
        for k, c in summaries if len(keys) else []:
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            hit = keys[at] == k
            np.add.at(exact, at[hit], c[hit])
        return keys[exact >= threshold]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []

        def done() -> pa.RecordBatch:
            at = settle(now, blobs).astype(np.int64) % bitmap_bits
            byte, bit = at >> 3, 1 << (at & 7)
            where = np.unique(byte)
            value = np.zeros(len(where), dtype=np.int32)
            np.bitwise_or.at(value, np.searchsorted(where, byte), bit.astype(np.int32))
            return pa.record_batch([pa.array(where, pa.int64()), pa.array(value, pa.int32())], names=["at", "bits"])

        for batch in rows:
            for row in batch.to_pylist():
                if row["part"] != now and blobs:
                    yield done()
                    blobs = []
                now = row["part"]
                blobs.append((row["mass"], row["once"], row["more"], row["counts"]))
        if blobs:
            yield done()

    return run


def _block(rows: pa.Table) -> pa.Table:
    out = np.zeros(BLOCK, dtype=np.uint8)
    out[rows.column("at").to_numpy() % BLOCK] = rows.column("bits").to_numpy()
    return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int64()), "bytes": pa.array([out.tobytes()], pa.binary())})


def _bitmap(spark: SparkSession, docs: DataFrame, sizes: tuple[int, ...], parts: int, threshold: int, bits: int, before) -> bytes:
    """The bitmap of frequent n-grams of the given sizes, added to ``before``."""
    sent = docs.mapInArrow(_summaries(sizes, parts, before), "part int, mass long, once binary, more binary, counts binary")
    met = (sent.repartition(parts, "part").sortWithinPartitions("part")
           .mapInArrow(_survivors(threshold, parts, bits), "at long, bits int"))
    # A row for each block of bytes, so what the driver reads is bounded by the bitmap's size.
    blocks = (met.groupBy("at").agg(F.bit_or("bits").alias("bits")).withColumn("block", F.expr(f"at div {BLOCK}"))
              .groupBy("block").applyInArrow(_block, "block long, bytes binary"))
    out = np.zeros(bits // 8, dtype=np.uint8) if before is None else np.frombuffer(before.value, dtype=np.uint8).copy()
    for row in blocks.toLocalIterator():
        part = np.frombuffer(row.bytes, dtype=np.uint8)
        out[row.block * BLOCK : row.block * BLOCK + BLOCK] |= part[: len(out) - row.block * BLOCK]
    return out.tobytes()


class Tally:
    """Counts of phrases by hash, each phrase spelled out when it is first met."""

    def __init__(self):
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.rows: np.ndarray = np.zeros(0, dtype=np.int64)  # the phrase of each hash, by its place below
        self.lang: list[str] = []
        self.n: list[int] = []
        self.phrase: list[bytes] = []

    def add(self, h: np.ndarray, at: np.ndarray, n: int, words: Words, names: dict[int, str]) -> None:
        order = np.argsort(h)
        ranked = h[order]
        first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(h) else np.zeros(0, np.int64)
        f, one, h = np.diff(np.r_[first, len(h)]), at[order[first]], ranked[first]
        place = np.searchsorted(self.hashes, h)
        known = self.hashes[np.minimum(place, len(self.hashes) - 1)] == h if len(self.hashes) else np.zeros(len(h), dtype=bool)
        self.counts[place[known]] += f[known]
        fresh = ~known
        rows = len(self.n) + np.arange(int(fresh.sum()))
        self.lang.extend(names[c] for c in words.lang[one[fresh]].tolist())
        self.n.extend([n] * len(rows))
        self.phrase.extend(words.phrase(i, n) for i in one[fresh].tolist())
        self.hashes = np.insert(self.hashes, place[fresh], h[fresh])
        self.counts = np.insert(self.counts, place[fresh], f[fresh])
        self.rows = np.insert(self.rows, place[fresh], rows)

    def record_batch(self) -> pa.RecordBatch:
        f = np.zeros(len(self.n), dtype=np.int64)
        f[self.rows] = self.counts
        return pa.record_batch([pa.array(self.lang, pa.string()), pa.array(self.n, pa.int32()), pa.array(self.phrase, pa.binary()), pa.array(f)],
                               names=["lang", "n", "phrase", "f"])


def _counts(bitmap) -> Callable:
    """Rows (lang, n, phrase, f) of a task's texts; n = 0 carries the number of words."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, dtype=np.uint8)
        tally, totals, n_words = Tally(), {}, 0
        for words, names in _batches(rows):
            n_words += len(words.start)
            for code, f in zip(*(x.tolist() for x in np.unique(words.lang, return_counts=True))):
                totals[names[code]] = totals.get(names[code], 0) + f
            for n in range(1, LONGEST + 1):
                h, at = _allowed(words, n, bits)
                keep = has_bit(bits, h)
                tally.add(h[keep], at[keep], n, words, names)
            if n_words >= TALLIED:
                yield tally.record_batch()
                tally, n_words = Tally(), 0
        yield tally.record_batch()
        yield pa.record_batch([pa.array(list(totals), pa.string()), pa.array([0] * len(totals), pa.int32()), pa.array([b""] * len(totals), pa.binary()),
                               pa.array(list(totals.values()), pa.int64())], names=["lang", "n", "phrase", "f"])

    return run


def phrase_counts(docs: DataFrame, threshold: int = 30, part_bytes: int = PART_BYTES, bitmap_bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(phrases, words): lang, n, phrase, f of every phrase of one to four words with f >= threshold; lang, n of all words.

    Both are read from a table in the shared folder.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    scratch = Scratch(spark, "phrases")
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    bitmap = None
    for sizes in ((1, 2), (3, 4)):
        value = _bitmap(spark, texts, sizes, parts, threshold, bitmap_bits, bitmap)
        if bitmap is not None:
            bitmap.destroy()
        bitmap = spark.sparkContext.broadcast(value)
        release(spark)
    counted = (texts.mapInArrow(_counts(bitmap), "lang string, n int, phrase binary, f long")
               .groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where((F.col("n") == 0) | (F.col("f") >= threshold)))
    table = scratch.save(counted.select("lang", "n", F.col("phrase").cast("string").alias("phrase"), "f"), "counts")
    bitmap.destroy()
    return table.where("n > 0"), table.where("n = 0").select("lang", F.col("f").alias("n"))


def _part(first: int, n: int) -> Column:
    return F.array_join(F.slice("words", first + 1, n), " ")


def collocations(docs: DataFrame, threshold: int = 30, top: int = 2000, scale: int = 2_000_000, percent: int = 80, **sizes) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to four words.

    A phrase counts from ``threshold`` occurrences on. It is cut after its first k words, l and r being the
    counts of the two parts and floor(scale * a / (l + r)) the score; the lowest cut counts, the first of ties.
    Phrases inside a longer one with at least ``percent`` % of their occurrences go, whether that one stays or not.
    Order: score and a descending, then the phrase by its UTF-8 bytes. Arithmetic is in decimals.
    """
    phrases, totals = phrase_counts(docs, threshold, **sizes)
    found = phrases.where("n > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = found.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(0, F.col("k")).alias("head"), F.array_join(F.expr("slice(words, k + 1, 4)"), " ").alias("tail"))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.expr(f"CAST(a AS DECIMAL(20, 0)) * {scale} div (CAST(l AS DECIMAL(20, 0)) + r)")
    least = (cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
             .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    inner = found.where(F.size("words") > 2).select(
        "lang", "a", F.explode(F.expr("""flatten(transform(sequence(2, size(words) - 1), m ->
            transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))))""")).alias("phrase"))
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = (least.join(covered, ["lang", "phrase"], "left")
            .where(F.expr(f"longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {percent}")))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # The first of every slice of a language, then the first of those: no task sorts all phrases of one.
    slices = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(slices))).orderBy(*order)
    ranked = left.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
