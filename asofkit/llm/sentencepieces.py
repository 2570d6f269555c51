"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The transducer composes the normaliser (a space in front, spaces as U+2581), the pieces and the
byte fallback. Its states are positions with the last piece; an arc is a piece that may follow.
For a model of merges the weight of an arc is zero or infinite: a sequence of pieces is the
model's result if each neighbouring pair, merged on its own, comes out as that pair, and exactly
one sequence is. The tropical shortest path from position to position is therefore found by
keeping, for each position, the one piece of finite weight that ends there. Arc weights are
computed when first needed and kept.

Pieces never cross the start of a run of spaces nor a control character, so a text is composed
unit by unit and equal units are composed once per worker.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kept import kept
from .textbytes import _power, chunks, mix
from .token_io import RaggedCache, encode_units

SPACE_MARK = "▁"
#: Longer units are composed one by one.
LONG_UNIT = 48
#: Units that are composed at once; their tables are the largest thing that a worker holds for a moment.
UNITS = 5000


class Transducer:
    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        self.ids = {p: i for i, (p, s) in enumerate(zip(names, special)) if not s}
        self.cost = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.byte_id = {int(names[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.crossing = any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.ids)
        if self.crossing:
            raise ValueError("pieces that go on after a space are not supported")
        #: Control characters that no piece holds stand alone.
        self.alone = np.zeros(256, dtype=bool)
        self.alone[sorted(set(range(32)) - {ord(c) for p in self.ids for c in p})] = True
        self.names = names
        self.weights: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}  # pieces that come out whole at the start of a unit

    def merge(self, text: str) -> list[str]:
        """The model's merges, best score first and leftmost of equals."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        queue: list = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                if both in self.cost:
                    heapq.heappush(queue, (self.cost[both], i, j, both))
        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or right[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            right[i] = right[j]
            if right[i] < len(parts):
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def _name(self, state: int) -> str:
        return self.names[state] if state >= 0 else chr(-1 - state)

    def finite(self, a: int, b: int) -> bool:
        """Whether piece ``b`` may follow piece ``a``; below zero stand characters without a piece."""
        if len(self.weights) > 250_000:
            self.weights.clear()
        pair = [self._name(a), self._name(b)]
        known = self.weights[a << 32 | b & 0xFFFFFFFF] = self.merge("".join(pair)) == pair
        return known

    def shortest_path(self, text: str) -> list[int]:
        n, ids, weights = len(text), self.ids, self.weights
        last: list[int | None] = [None] * (n + 1)  # the piece of finite weight that ends at each position
        size = [0] * (n + 1)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):  # longest first
                piece = ids.get(text[i:j])
                if piece is None:
                    if i < j - 1:
                        continue
                    piece = -1 - ord(text[i])
                if i:
                    before = last[i]
                    if before is None:
                        continue
                    known = weights.get(before << 32 | piece & 0xFFFFFFFF)
                    if known is None:
                        known = self.finite(before, piece)
                elif (known := self.whole.get(piece)) is None:
                    known = self.whole[piece] = self.merge(text[:j]) == [text[:j]]
                if known:
                    last[j], size[j] = piece, j - i
                    break
        out, j = [], n
        while j:
            if last[j] is None:  # no path: the merges decide
                return [self.ids.get(p, -1 - ord(p[0])) for p in self.merge(text)]
            out.append(last[j])
            j -= size[j]
        return out[::-1]

    def _with_bytes(self, path: list[int]) -> list[int]:
        """Characters without a piece as their bytes."""
        if min(path) >= 0:
            return path
        back = lambda c: [self.byte_id[b] for b in chr(c).encode()] if self.byte_id else [self.unknown]
        return [x for i in path for x in ([i] if i >= 0 else back(-1 - i))]

    def _compile(self) -> None:
        """Arrays for many units at once: pieces by hash, and the weights met so far."""
        text = "".join(self.ids)
        size = np.fromiter(map(len, self.ids), np.int64, len(self.ids))
        code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(code.astype(np.uint64)) * _power("up", len(code)))])
        start = np.cumsum(size) - size
        h = mix((sums[start + size] - sums[start]) * _power("down", len(code))[start])
        ids = np.fromiter(self.ids.values(), np.int32, len(self.ids))
        self.slots = []  # of pieces that share a place the later one goes to the next table
        while len(h):
            shift = np.uint64(44 - 7 * len(self.slots))
            keys, names = np.zeros(1 << 20, np.uint64), np.full(1 << 20, -1, np.int32)
            at = (h >> shift & np.uint64(0xFFFFF)).astype(np.int64)
            keys[at], names[at] = h, ids
            left = keys[at] != h
            self.slots.append((shift, keys, names))
            h, ids = h[left], ids[left]
        self.pair_keys = np.full(1 << 21, -1, np.int64)
        self.pair_known = np.zeros(1 << 21, bool)
        self.whole_known = np.full(len(self.names), -1, np.int8)

    def _pieces(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        for shift, keys, names in self.slots:
            at = (h >> shift & np.uint64(0xFFFFF)).astype(np.int64)
            out = np.where(keys[at] == h, names[at], out)
        return out

    def _weight(self, key: int) -> bool:
        known = self.weights.get(key)
        b = key & 0xFFFFFFFF
        return self.finite(key >> 32, b - (1 << 32) if b >> 31 else b) if known is None else known

    def _may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        key = before << 32 | piece & 0xFFFFFFFF
        at = (mix(key.view(np.uint64)) >> np.uint64(43)).astype(np.int64)
        new, first = np.unique(np.where(self.pair_keys[at] != key, key, -1), return_index=True)
        for k, place in zip(new.tolist(), at[first].tolist()):
            if k == -1:
                continue
            known = self._weight(k)
            self.pair_keys[place], self.pair_known[place] = k, known
        out = self.pair_known[at]
        for i in np.flatnonzero(self.pair_keys[at] != key).tolist():  # another pair of this call took its place
            out[i] = self._weight(int(key[i]))
        return out

    def shortest_paths(self, texts: list[str]) -> list[list[int]]:
        """The paths of many short units, all positions of one number at a time; longest units first."""
        if not hasattr(self, "slots"):
            self._compile()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        width = int(size[0])
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        row = np.repeat(np.arange(len(texts)), size)
        code = np.zeros((width, len(texts)), np.uint32)
        code[place, row] = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        up, down = _power("up", width + 1), _power("down", width + 1)
        sums = np.zeros((width + 1, len(texts)), np.uint64)
        np.cumsum(mix(code.astype(np.uint64)) * up[:width, None], axis=0, out=sums[1:])
        none = -(1 << 40)
        last = np.full((width + 1, len(texts)), none, np.int64)
        step = np.zeros((width + 1, len(texts)), np.int64)
        last[0] = 0
        for j in range(1, width + 1):
            open_ = np.arange(int(np.searchsorted(-size, -j, "right")))
            for n in range(min(self.longest, j), 0, -1):
                i = j - n
                rows = open_[last[i, open_] != none]
                piece = self._pieces(mix((sums[j, rows] - sums[i, rows]) * down[i]))
                if n == 1:
                    piece = np.where(piece < 0, -1 - code[i, rows].astype(np.int64), piece)
                else:
                    rows, piece = rows[piece >= 0], piece[piece >= 0]
                if not len(rows):
                    continue
                if i:
                    fine = self._may_follow(last[i, rows], piece)
                else:
                    fine = np.ones(len(rows), bool)
                    real = piece >= 0
                    for p in np.unique(piece[real])[self.whole_known[np.unique(piece[real])] < 0].tolist():
                        self.whole_known[p] = self.merge(self.names[p]) == [self.names[p]]
                    fine[real] = self.whole_known[piece[real]] > 0
                last[j, rows[fine]], step[j, rows[fine]] = piece[fine], n
                open_ = open_[last[j, open_] == none]
                if not len(open_):
                    break
        out = []
        for path, steps, j, t in zip(last.T.tolist(), step.T.tolist(), size.tolist(), texts):
            ids = []
            while j > 0 and path[j] != none:
                ids.append(path[j])
                j -= steps[j]
            out.append(ids[::-1] if not j else self.shortest_path(t))
        return out

    def encode_units(self, raw: list[bytes]) -> list[list[int]]:
        texts = [x.decode("utf-8").replace(" ", SPACE_MARK) for x in raw]
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        out: list = [None] * len(raw)
        long = [i for i in order if len(texts[i]) > LONG_UNIT]
        for i in long:
            out[i] = self._with_bytes(self.shortest_path(texts[i]))
        short = order[len(long):]
        for s in range(0, len(short), UNITS):
            part = short[s : s + UNITS]
            for i, ids in zip(part, self.shortest_paths([texts[i] for i in part])):
                out[i] = self._with_bytes(ids)
        return out


def _transducer(path: str):
    """The worker's transducer and unit cache; tasks that follow at once go on with them."""
    return kept(("pieces", path), lambda: (Transducer(path), RaggedCache()))


class Surfaces:
    """What each id stands for when decoding."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        text = [b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else bytes([int(p[3:-1], 16)]) if model.is_byte(i)
                else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(names)]
        self.surface = np.frombuffer(b"".join(text), dtype=np.uint8)
        self.surface_start = np.concatenate([[0], np.cumsum([len(x) for x in text])])
        self.dummy = np.array([p.startswith(SPACE_MARK) for p in names])


def _with_dummy_prefix(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space in front of each document that is not empty."""
    add = (np.diff(offsets) > 0).astype(np.int64)
    moved = offsets + np.concatenate([[0], np.cumsum(add)])
    out = np.full(int(moved[-1]), 32, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(np.cumsum(add), np.diff(offsets))] = data
    return out, moved


def _unit_starts(data: np.ndarray, offsets: np.ndarray, alone: np.ndarray) -> np.ndarray:
    space, control = data == 32, alone[data]
    start = space | control
    start[1:] &= ~(space[1:] & space[:-1])
    start[1:] |= control[:-1]
    # After a literal U+2581 a space goes on with its run.
    mark = (data[2:] == 0x81) & (data[1:-1] == 0x96) & (data[:-2] == 0xE2) if len(data) > 2 else np.zeros(0, bool)
    start[3:] &= ~(mark[: max(0, len(data) - 3)] & space[3:])
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[begins] = True
    return np.flatnonzero(start)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _transducer(path) as (fst, cache):
            yield from encoded(fst, cache, batches)

    def encoded(fst, cache, batches):
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column("text")):
                data, offsets = _with_dummy_prefix(data, offsets)
                starts = _unit_starts(data, offsets, fst.alone) if len(data) else np.zeros(0, np.int64)
                counts, ids = np.zeros(j - i, np.int64), np.zeros(0, np.int32)
                if len(starts):
                    ids, lens = encode_units(cache, data, starts, np.append(starts[1:], len(data)), fst.encode_units)
                    counts = np.bincount(np.searchsorted(offsets, starts, "right") - 1, weights=lens, minlength=j - i).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], names=["id", "ids"])
    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with kept(("surfaces", path), lambda: Surfaces(path)) as fst:
            yield from decoded(fst, batches)

    def decoded(fst, batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                lists = part.column("ids")
                ids = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)
                count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(count)
                lens = fst.surface_start[ids + 1] - fst.surface_start[ids]
                first = (ends - count)[count > 0]
                skip = np.zeros(len(ids), np.int64)
                skip[first] = fst.dummy[ids[first]]  # the space that the normaliser put in front
                at, lens = fst.surface_start[ids] + skip, lens - skip
                raw = fst.surface[np.repeat(at - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))].tobytes()
                cuts = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], ends])].tolist()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, pa.array(texts, pa.string())], names=["id", "ids", "decoded"])
    return run


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): piece ids of each whole text, as the model gives them.

    Null or empty text gives no ids; rows stay as many as they were; an empty table gives none.
    Other columns are not read.
    """
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        _encode(model_path), "id bigint, ids array<int>")
    return out.select(F.col("id").alias(id_col), "ids")


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids_col, decoded). Null ids decode to empty text; bytes that are no UTF-8 are replaced."""
    out = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(
        _decode(model_path), "id bigint, ids array<int>, decoded string")
    return out.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), "decoded")


def _both(path: str):
    encode, decode = _encode(path), _decode(path)
    return lambda batches: decode(encode(batches))


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded): encode_pieces and decode_pieces of it in one worker a task, where one after the other takes two."""
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        _both(model_path), "id bigint, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)
