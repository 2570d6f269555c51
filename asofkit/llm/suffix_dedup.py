"""Removing byte strings that occur more than once: a depth-limited radix sort of suffixes.

Two suffixes that agree on their first ``length`` bytes start a repeated window; nothing deeper
matters, so suffixes are ordered only that far, digit by digit, most significant digit first, and
groups that hold one suffix leave after each pass. To keep the first pass small, suffixes are
sorted at synchronising positions only: the positions whose ``length // 4`` bytes have the least
hash of some window. Which position a window chooses depends on its bytes alone, so equal windows
choose equal positions, and every window is judged through the position it chooses:

1. first digit: the quarter at the position itself. Suffixes alone in their group leave;
2. all bytes that a window through the position can hold, its context. Suffixes that agree make all
   their windows repeated, and go on as one;
3. second digit: the quarter with half of the rest behind it, or with half of the rest ahead of it.
   A window holds one of the two, so contexts that are alone with both leave;
4. last digit: the windows through the position, one for each distance of the position from the
   window's start. Equal groups are exactly the repeated windows. Contexts of one first digit meet
   in a task as long as they are few; beyond, runs of neighbouring windows are sorted first, by
   the bytes that they have in common and by those that they cover, and only runs in which the two
   tell different things are taken apart, into shorter runs and at last into windows.

What is removed rests on equal bytes or equal 128-bit digests; 64-bit hashes only discard.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, release
from .skew import join_counted
from .textbytes import _BYTE_VALUES, PrefixHash, _power, chunks, flat, mix

#: Contexts of one first digit that meet in a task; more of them are sorted by the shuffle.
GROUP_IN_TASK = 256
#: Windows of a run at each level; a level's number divides the one before.
TOGETHER = (100, 20, 4)
_NULL_ID = -(2**63)


def _digest(raw: bytes) -> bytes:
    return blake2b(raw, digest_size=16).digest()


def _sliding(values: np.ndarray, size: int, op) -> np.ndarray:
    """op over every run of ``size`` values, by running op inside blocks from both ends."""
    n = len(values)
    padded = np.full(-(-n // size) * size, values[-1], dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, size)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - size + 1], ahead[size - 1 : n])


def positions(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, PrefixHash | None]:
    """(synchronising positions, their documents, prefix hashes); windows stay inside documents."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, None
    digit = length // 4
    width = length - digit + 1
    hashes = PrefixHash(data)
    h = hashes.windows(digit)
    end = np.repeat(offsets[1:], np.diff(offsets))  # end of the document at each byte
    least = _sliding(h, width, np.minimum)
    least[np.arange(len(least)) + length > end[: len(least)]] = 0  # such windows cross documents
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = _sliding(padded, width, np.maximum)
    at = np.flatnonzero((chosen[: len(h)] == h) & (chosen[: len(h)] != 0))
    return at, np.searchsorted(offsets, at, "right") - 1, hashes


def _first_digits(length: int):
    """The first digit of every suffix at a synchronising position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offsets in chunks(batch.column("text")):
                at, doc, hashes = positions(data, offsets, length)
                if len(at):
                    row = pa.array(i + doc)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(hashes.ranges(at, at + length // 4).view(np.int64)), batch.column("id").take(row), batch.column("tk").take(row),
                        pa.array((at - offsets[doc]).astype(np.int32))], names=["digit", "id", "tk", "pos"])
    return run


def _listed(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of each element, elements) of a list column."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten()


def _find(length: int):
    """Contexts and second digits of the listed suffixes."""
    reach = length - length // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at_in = _listed(batch.column("at"))
            at_in = at_in.to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, data, offsets in chunks(batch.column("text")):
                own = slice(*np.searchsorted(row, [i, j]))
                doc = row[own] - i
                at = offsets[doc] + at_in[own]
                hashes = PrefixHash(data)
                lo = np.maximum(offsets[doc], at - reach)
                hi = np.minimum(offsets[doc + 1], at + length)
                raw, ahead = data.tobytes(), (at - lo).astype("<u4").tobytes()
                context = [_digest(raw[a:b]) + ahead[4 * k : 4 * k + 4] for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist()))]
                digit, half = length // 4, reach // 2
                front = mix(hashes.ranges(np.maximum(at - half, 0), at + digit) + np.uint64(1)).view(np.int64)
                back = hashes.ranges(at, np.minimum(at + digit + reach - half, len(data))).view(np.int64)
                take = pa.array(row[own])
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes.ranges(at, at + digit).view(np.int64)), pa.array(context, pa.binary()),
                    pa.array(front, mask=at - half < lo), pa.array(back, mask=at + digit + reach - half > hi),
                    batch.column("id").take(take), batch.column("tk").take(take), pa.array(at_in[own].astype(np.int32)), pa.array((hi - at).astype(np.int32)),
                ], names=["digit", "context", "front", "back", "id", "tk", "pos", "after"])
    return run


def _cut_contexts(length: int):
    reach = length - length // 4
    kept = ["digit", "context", "n", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            doc, fields = _listed(batch.column("need"))
            at = offsets[doc] + fields.field("pos").to_numpy(zero_copy_only=False)
            lo, hi = np.maximum(offsets[doc], at - reach), np.minimum(offsets[doc + 1], at + length)
            raw = data.tobytes()
            for s in range(0, len(at), 4096):
                cut = slice(s, s + 4096)
                yield pa.RecordBatch.from_arrays([
                    *[fields.field(c).slice(s, 4096) for c in kept], pa.array((at - lo)[cut].astype(np.int32)),
                    pa.array([raw[a:b] for a, b in zip(lo[cut].tolist(), hi[cut].tolist())], pa.binary()),
                ], names=[*kept, "ahead", "bytes"])
    return run


def _table(ahead: np.ndarray, contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first, end): a row per context; column 0 lies ``reach`` bytes ahead of the position."""
    reach = length - length // 4
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    table = np.zeros((len(contexts), reach + length), dtype=np.uint8)
    row = np.repeat(np.arange(len(contexts)), size)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(reach - ahead, size)
    table[row, place] = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    return table, reach - ahead, reach - ahead + size


def _hashes(table: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """A row per context and a column per start: hashes of ``width`` bytes."""
    sums = np.zeros((table.shape[0], table.shape[1] + 1), dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[table] * _power("up", table.shape[1]), axis=1, out=sums[:, 1:])
    return mix((sums[:, start + width] - sums[:, start]) * _power("down", table.shape[1])[start])


def _repeated(length: int):
    """Rows sorted by digit -> (context, most, least): bytes ahead of the outermost repeated windows."""
    reach = length - length // 4

    def solve(rows: list) -> pa.RecordBatch:
        context, n, ahead, contexts = zip(*(r[1:] for r in rows))
        table, first, end = _table(np.array(ahead, np.int64), list(contexts), length)
        start = np.arange(reach + 1)
        there = (start >= first[:, None]) & (start + length <= end[:, None])
        # A window's bytes hold the position's digit, so groups of several digits never mix.
        h = np.where(there, _hashes(table, start, length), np.arange(1, len(rows) + 1, dtype=np.uint64)[:, None]).T.copy()
        order = np.argsort(h, axis=1, kind="stable")
        ranked = np.take_along_axis(h, order, axis=1)
        same = ranked[:, 1:] == ranked[:, :-1]
        # The partner of each window is its neighbour in the order; -1 where there is none.
        partner = np.full(h.shape, -1)
        beside = np.full(h.shape, -1)
        beside[:, 1:][same] = order[:, :-1][same]
        beside[:, :-1][same] = order[:, 1:][same]
        np.put_along_axis(partner, order, beside, axis=1)
        partner = np.where(there, partner.T, -1)
        out = []
        for i in np.flatnonzero((partner >= 0).any(axis=1)).tolist():
            hit = np.flatnonzero(partner[i] >= 0).tolist()
            equal = lambda s: (table[i, s : s + length] == table[partner[i, s], s : s + length]).all()  # noqa: B023, E731
            low = next((s for s in hit if equal(s)), None)  # the outermost windows by their bytes
            if low is not None:
                out.append((context[i], reach - low, reach - next(s for s in reversed(hit) if equal(s))))
        context, most, least = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(context, pa.binary()), pa.array(most, pa.int32()), pa.array(least, pa.int32())],
                                          names=["context", "most", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("digit", "context", "n", "ahead", "bytes"))):
                if len(held) >= 1000 and r[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(r)
        if held:
            yield solve(held)
    return run


def _widths(length: int) -> list[int]:
    """Windows of a run, level by level; each level splits the runs of the one before."""
    return [w for w in TOGETHER if w <= length // 4] + [1]


def _runs(length: int, wide: int, within: int | None):
    """Each run of ``wide`` neighbouring windows of a context: hash of what they have in common, digest of what they cover.

    Of the context's listed runs of ``within`` windows only, and with their counts, if given.
    """
    reach = length - length // 4
    start = np.arange(0, reach + 1, wide)
    last = np.minimum(start + wide - 1, reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                names, contexts, n = (part.column(c).to_pylist() for c in ("context", "bytes", "n"))
                table, first, end = _table(part.column("ahead").to_numpy().astype(np.int64), contexts, length)
                count = np.repeat(np.array(n, np.int64)[:, None], len(start), axis=1)
                there = (last >= first[:, None]) & (start + length <= end[:, None])
                if within:
                    count[:] = 0  # no listed run counts for none
                    of, listed = _listed(part.column("runs"))
                    outer = listed.field("run").to_numpy(zero_copy_only=False).astype(np.int64) * (within // wide)
                    for j in range(within // wide):
                        own = outer + j < len(start)
                        count[of[own], outer[own] + j] = listed.field("n").to_numpy(zero_copy_only=False)[own]
                    there &= count > 0
                row, which = np.nonzero(there)
                sums = np.zeros((table.shape[0], table.shape[1] + 1), dtype=np.uint64)
                np.cumsum(_BYTE_VALUES[table] * _power("up", table.shape[1]), axis=1, out=sums[:, 1:])
                a, b = start[which], last[which]
                core = mix((sums[row, a + length] - sums[row, b]) * _power("down", table.shape[1])[b])
                whole = ((a >= first[row]) & (b + length <= end[row])).tolist()
                hull = [_digest(table[i, c : d + length].tobytes()) if w else names[i] for i, c, d, w in zip(row.tolist(), a.tolist(), b.tolist(), whole)]
                yield pa.RecordBatch.from_arrays([
                    part.column("context").take(pa.array(row)), pa.array(count[row, which]), pa.array(which.astype(np.int32)),
                    pa.array(core.view(np.int64)), pa.array(hull, pa.binary())], names=["context", "n", "run", "core", "hull"])
    return run


def _large(contexts: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(context, most, least) for groups of any size, by the shuffle alone: runs of windows, then of fewer, then windows."""
    reach = length - length // 4
    sure, wanted, within = [], None, None
    for wide in _widths(length):
        held = (contexts.join(wanted, "context") if within else contexts).select("context", "n", "ahead", "bytes", *(["runs"] if within else []))
        runs = scratch.save(held.mapInArrow(_runs(length, wide, within), "context binary, n bigint, run int, core bigint, hull binary"), f"runs{wide}")
        total = runs.count()
        hulls = scratch.save(runs.groupBy("core", "run", "hull").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("context").alias("context")),
                             f"hulls{wide}")
        release(scratch.spark)
        # Runs that cover the same bytes have the same windows.
        told = join_counted(runs.select("context", "run", "hull"), hulls.where("n > 1").groupBy("hull", "run").agg(F.sum("rows").alias("rows")),
                            ["hull", "run"], "rows", total)
        first = F.col("run") * wide
        sure.append(scratch.save(told.groupBy("context").agg(
            F.max(F.lit(reach) - first).cast("int").alias("most"),
            F.min(F.lit(reach) - F.least(first + wide - 1, F.lit(reach))).cast("int").alias("least")), f"sure{wide}"))
        scratch.drop(f"runs{wide}")
        if wide > 1:
            # Runs that have the common bytes alone with others are split: one for all that cover the same bytes.
            open_ = join_counted(hulls, hulls.groupBy("core", "run").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), ["core", "run"], "kinds", total)
            wanted = scratch.save(open_.groupBy("context").agg(F.collect_set(F.struct("run", "n")).alias("runs")), f"wanted{wide}")
        scratch.drop(f"hulls{wide}")
        release(scratch.spark)
        within = wide
    return reduce(DataFrame.unionByName, sure).groupBy("context").agg(F.max("most").alias("most"), F.min("least").alias("least"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        raw = data.tobytes()
        bounds, found = offsets.tolist(), batch.column("found").to_pylist()
        for s in range(0, batch.num_rows, 512):
            spans, kept = [], []
            for i in range(s, min(s + 512, batch.num_rows)):
                merged: list[list[int]] = []
                for r in sorted(found[i] or (), key=lambda r: (r["start"], r["end"])):
                    if merged and r["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r["end"])
                    else:
                        merged.append([r["start"], r["end"]])
                own, at, parts = raw[bounds[i] : bounds[i + 1]], 0, []
                for a, b in merged:
                    parts.append(own[at:a])
                    at = b
                kept.append(b"".join([*parts, own[at:]]))
                spans.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([
                batch.column("id").slice(s, 512), pa.array(np.diff(offsets[s : s + 512 + 1]), pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_bytes, spans (removed byte ranges), kept (the other bytes).

    A byte goes if it lies in a ``length``-byte string that also starts anywhere else, in the same
    document too. Null text is empty; documents shorter than ``length`` keep all; repeated rows
    are repeats of each other; an empty table gives no rows. Only the two named columns are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tk", F.xxhash64("text"))
    reach = length - length // 4

    # Pass 1: groups of one leave.
    suffixes = scratch.save(texts.mapInArrow(_first_digits(length), "digit bigint, id bigint, tk bigint, pos int"), "suffixes")
    groups = scratch.save(suffixes.groupBy("digit").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "groups")
    total = suffixes.count()
    at = join_counted(suffixes, groups, ["digit"], "rows", total).groupBy("id", "tk").agg(F.collect_set("pos").alias("at"))
    left = scratch.save(texts.join(at.hint("shuffle_hash"), ["id", "tk"]).mapInArrow(
        _find(length), "digit bigint, context binary, front bigint, back bigint, id bigint, tk bigint, pos int, after int"), "left")
    scratch.drop("suffixes", "groups")
    release(spark)

    # Pass 2: a row for each context.
    one = scratch.save(left.groupBy("context").agg(
        F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("digit", "front", "back", "after")], F.min(F.struct("id", "tk", "pos")).alias("r")), "one")
    contexts = one.count()

    # Pass 3.
    half = one.select("context", F.explode(F.array("front", "back")).alias("half")).where("half is not null")
    halves = scratch.save(half.groupBy("half").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "halves")
    again = join_counted(half, halves, ["half"], "kinds", 2 * contexts).select("context").distinct()
    mixed = one.join(again, "context")
    sizes = scratch.save(mixed.groupBy("digit").agg(F.count(F.lit(1)).alias("m")), "sizes")
    mixed = join_counted(mixed, sizes, ["digit"], "m", contexts)

    # Pass 4, on the bytes of one suffix of each context.
    need = mixed.groupBy("r.id", "r.tk").agg(F.collect_list(F.struct("digit", "context", "n", "m", "r.pos")).alias("need"))
    bytes_ = scratch.save(texts.join(need.hint("shuffle_hash"), ["id", "tk"]).select("text", "need").mapInArrow(
        _cut_contexts(length), "digit bigint, context binary, n bigint, m bigint, ahead int, bytes binary"), "contexts", compression="zstd")
    release(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = (bytes_.where(F.col("m") <= GROUP_IN_TASK).repartition(parts, "digit").sortWithinPartitions("digit")
           .mapInArrow(_repeated(length), "context binary, most int, least int"))
    judged = scratch.save(few.unionByName(_large(bytes_.where(F.col("m") > GROUP_IN_TASK), length, scratch)).dropDuplicates(["context"]), "judged")
    scratch.drop("contexts", *(f"{t}{w}" for w in _widths(length) for t in ("sure", "wanted")))

    # All windows of a context that occurs twice are repeated.
    ahead = F.least(F.lit(reach), F.col("r.pos"))
    once = one.where("n = 1").join(judged, "context").select("context", "n", "most", "least")
    told = scratch.save(one.where("n > 1").select("context", "n", ahead.alias("most"), F.greatest(F.lit(0), F.lit(length) - F.col("after")).alias("least"))
                        .unionByName(once), "told")
    parts = join_counted(left.select("context", "id", "tk", "pos"), told, ["context"], "n", total).select(
        "id", "tk", (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") - F.col("least") + length).alias("end"))
    ranges = scratch.save(parts.groupBy("id", "tk").agg(F.collect_set(F.struct("start", "end")).alias("found")), "ranges")
    scratch.drop("left", "one", "halves", "sizes", "judged", "told")
    release(spark)
    out = (texts.join(ranges.hint("shuffle_hash"), ["id", "tk"], "left").select("id", "text", "found")
           .mapInArrow(_remove, "id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"))
    return out.select(F.when(F.col("id") != _NULL_ID, F.col("id")).alias(id_col), "n_bytes", "spans", "kept")
