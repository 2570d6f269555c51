"""Token-ID output: Parquet list columns with delta encoding, small row groups and page indexes.

Documents are dealt by range of their identifier and sorted, so the files in name order hold the
corpus in ascending order. Readers may take only ``doc_id, n_tokens, part, offset`` (token counts
and positions, from a few pages) or only the row groups of some identifiers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kept import kept
from .textbytes import SPACE, PrefixHash, chunks

#: File format: delta-packed integers in version-2 pages, row groups and pages of fixed size,
#: column and offset indexes (always written by the Parquet library).
FORMAT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.block.size": str(8 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.page.row.count.limit": "2000",
    "compression": "zstd",
}
FILE_SCHEMA = "doc_id bigint, part int, offset bigint, n_tokens bigint, tokens array<int>"


_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_SIGN = np.array([32 < b < 127 and not chr(b).isalnum() and chr(b) != "'" for b in range(256)])


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of units: about a run of ASCII white space with the run of letters or signs after it.

    A byte-level BPE never merges across such a start. One that follows another kind of Unicode
    white space is no start, since the pattern takes both together.
    """
    n = len(data)
    space = SPACE[data]
    start = space.copy()
    start[1:] &= ~space[:-1]
    back = lambda k: np.concatenate([np.zeros(min(k, n), np.uint8), data[: max(0, n - k)]])
    one, two, three = back(1), back(2), back(3)
    wide = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | (
        (three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A)))
    start &= ~wide
    # After an ASCII letter the pattern also parts at ASCII signs other than the apostrophe.
    start[1:] |= _SIGN[data[1:]] & _LETTER[data[:-1]]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[begins] = True
    return np.flatnonzero(start)


class RaggedCache:
    """Id lists by 64-bit unit hash, in sorted arrays; emptied when it would hold over ``limit`` units."""

    def __init__(self, limit: int = 1_000_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.slots = np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(1 << 16, dtype=np.int32)
        self.start = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0
        self.table = np.zeros(1 << 22, dtype=np.int32)
        self.by_slot = np.zeros(1 << 14, dtype=np.uint64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of the given hashes, -1 where there is none."""
        slot = self.table[hashes >> np.uint64(42)]
        there = self.by_slot[slot] == hashes
        rest = np.flatnonzero(~there)  # unknown, or a later hash has its place in the table
        slot = np.where(there, slot, -1)
        if len(rest) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes[rest]), len(self.hashes) - 1)
            slot[rest] = np.where(self.hashes[at] == hashes[rest], self.slots[at], -1)
        return slot

    def add(self, hashes: np.ndarray, lists: list) -> np.ndarray:
        """New sorted hashes with their lists; their slots."""
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int32, int(lens.sum()))
        n = len(self.hashes)
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.start) < n + len(lists) + 1:
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.by_slot = np.concatenate([self.by_slot, np.zeros_like(self.by_slot)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n + 1 : n + 1 + len(lists)] = self.used + np.cumsum(lens)
        self.used += len(ids)
        slots = np.arange(n, n + len(lists), dtype=np.int32)
        self.by_slot[slots] = hashes
        self.table[hashes >> np.uint64(42)] = slots
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.slots = np.insert(self.hashes, at, hashes), np.insert(self.slots, at, slots)
        return slots


def encode_units(cache: RaggedCache, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, ids per unit). ``encode`` turns a list of distinct byte strings into id lists."""
    units = PrefixHash(data).ranges(starts, ends)
    slot = cache.find(units)
    missing = np.flatnonzero(slot < 0)
    if len(missing):
        hashes, first, which = np.unique(units[missing], return_index=True, return_inverse=True)
        if len(cache.hashes) + len(hashes) > cache.limit and len(cache.hashes):
            cache.clear()
            return encode_units(cache, data, starts, ends, encode)
        raw = data.tobytes()
        first = missing[first]
        slot[missing] = cache.add(hashes, encode([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]))[which]
    begin = cache.start[slot]
    lens = cache.start[slot + 1] - begin
    shift = begin - (np.cumsum(lens) - lens)
    return cache.flat[np.repeat(shift, lens) + np.arange(int(lens.sum()))], lens


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each document; counts are ids per document, offsets are returned."""
    offsets = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(int(offsets[-1]), end_id, dtype=np.int32)
    inside = np.ones(len(out), dtype=bool)
    inside[offsets[1:] - 1] = False
    out[inside] = ids
    return out, offsets


def _unit_encoder(tokenizer):
    """Encode distinct units with little overhead.

    A space and Latin letters are a single piece to the pattern and go straight to the BPE model,
    as byte characters. Other units that begin with ASCII white space and end with none are joined:
    the tokenizer parts them again just there. Its tokens stand for known numbers of bytes, which
    tell each unit's tokens.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in set(visible)]
    names = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    model = tokenizer.model
    size = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)
    for token, i in tokenizer.get_vocab().items():  # one character of a token's name for each byte
        size[i] = len(token)

    def encode(raw: list[bytes]) -> list:
        texts = [b.decode("utf-8") for b in raw]
        out: list = [None] * len(raw)
        for i, t in enumerate(texts):
            if t[0] == " " and t[1:].isalpha() and max(t) < "\u0250":
                out[i] = [x.id for x in model.tokenize(raw[i].decode("latin-1").translate(names))]
        plain = [i for i, (b, t) in enumerate(zip(raw, texts)) if out[i] is None and b[0] <= 32 and not t[-1].isspace()]
        for s in range(0, len(plain), 2000):
            part = plain[s : s + 2000]
            ids = np.array(tokenizer.encode_batch_fast(["".join([texts[i] for i in part])], add_special_tokens=False)[0].ids, dtype=np.int64)
            ends = np.cumsum([len(raw[i]) for i in part])
            cuts = np.searchsorted(np.cumsum(size[ids]), ends) + 1
            ids = ids.tolist()
            for i, a, b in zip(part, [0, *cuts[:-1].tolist()], cuts.tolist()):
                out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out
    return encode


def _holds(column: pa.Array, marks: list[str]) -> np.ndarray:
    """Which texts hold a special string."""
    found = np.zeros(len(column), bool)
    for m in marks:
        found |= pc.fill_null(pc.match_substring(column, m), False).to_numpy(zero_copy_only=False)
    return found


def _encoder(path: str, end_id: int, plain_specials: bool):
    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = plain_specials
        marks = [] if plain_specials else [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        return tokenizer, marks, _unit_encoder(tokenizer), RaggedCache()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with kept(("tokens", path, plain_specials), make) as (tokenizer, marks, encode, cache):
            done = 0
            for batch in batches:
                text = batch.column("text")
                special = _holds(text, marks)  # the library cuts these texts first, so it gets them whole
                usual = pc.if_else(pa.array(special), "", text) if special.any() else text
                for i, j, data, offsets in chunks(usual):
                    n = j - i
                    starts = unit_starts(data, offsets)
                    if len(starts):
                        ids, lens = encode_units(cache, data, starts, np.append(starts[1:], len(data)), encode)
                        doc = np.searchsorted(offsets, starts, "right") - 1
                        counts = np.bincount(doc, weights=lens, minlength=n).astype(np.int64)
                    else:
                        ids, counts = np.zeros(0, np.int32), np.zeros(n, np.int64)
                    for r in np.flatnonzero(special[i:j]).tolist():
                        own = np.array(tokenizer.encode(text[i + r].as_py(), add_special_tokens=False).ids, np.int32)
                        ids, counts[r] = np.insert(ids, int(counts[:r].sum()), own), len(own)
                    flat, bounds = with_end(ids, counts, end_id)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").slice(i, n), batch.column("part").slice(i, n),
                        pa.array(done + bounds[:-1], pa.int64()), pa.array(counts + 1, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())),
                    ], names=["doc_id", "part", "offset", "n_tokens", "tokens"])
                    done += int(bounds[-1])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text", partitions: int | None = None, plain_specials: bool = False) -> None:
    """Encode every document and write the token files in ascending identifier order.

    Null text is empty: only the end id. Rows that tie in the identifier (null ones come first)
    are ordered by text. An empty table writes a file without rows. Other columns are not read.
    Special strings inside a text become their special ids, as the library does unasked; with
    ``plain_specials`` they are ordinary text.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
             .select("doc_id", "text", F.spark_partition_id().alias("part")))
    dealt.mapInArrow(_encoder(tokenizer_path, end_id, plain_specials), FILE_SCHEMA).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, part, offset) from the count columns alone."""
    files = read_tokens(spark, path).select("doc_id", "part", "offset", "n_tokens")
    # One row per written part: few and bounded by the number of parts.
    base = files.groupBy("part").agg(F.sum("n_tokens").alias("t")).select(
        "part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return files.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "part", "offset")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("tokens")
        values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="<u4")
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        view = memoryview(values).cast("B")
        crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("offset"),
                                          pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())],
                                         names=["doc_id", "part", "offset", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    read = read_tokens(spark, path).select("doc_id", "part", "offset", "tokens")
    digests = read.mapInArrow(_digest, "doc_id bigint, part int, offset bigint, n_tokens bigint, ids_crc32 bigint")
    base = token_positions(spark, path).groupBy("part").agg(F.min(F.col("start") - F.col("offset")).alias("base"))
    return digests.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
