"""Vectorised views of text columns as bytes: words, hashes and shingles of a whole batch at once.

All helpers work on one flat byte array with document offsets, as Arrow stores strings. Words are
runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 are exactly the runs of characters
other than those. Hashes are 64-bit polynomial hashes with a final mix; equal strings always have
equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into arrays at once; a longer document is taken alone.
CHUNK_BYTES = 2_000_000

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words, so that any bits of a hash are usable."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


#: Longer tables of powers are made anew for each use, so that one long document leaves nothing behind.
KEPT_POWERS = 1 << 22


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        base = np.full(m, np.uint64(_BASE % 2**64 if kind == "up" else _INVERSE), dtype=np.uint64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if m <= KEPT_POWERS:
            _powers[kind] = have
    return have[:n]


class PrefixHash:
    """Hashes of any byte ranges of one flat array, from one pass of prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[data] * _power("up", n), out=self.sums[1:])
        self.inverse = _power("down", n + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def windows(self, size: int) -> np.ndarray:
        """Hash of every window of ``size`` bytes; same values as ``ranges``."""
        h = (self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size]
        return mix(h + np.uint64(size * 0x9E3779B97F4A7C15 % 2**64))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, values = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of about ``limit`` bytes."""
    data, offsets = flat(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; words never cross documents."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def lower_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word after lower-casing A-Z."""
    start, end, doc = word_bounds(data, offsets)
    return (PrefixHash(LOWER[data]).ranges(start, end) if len(start) else np.zeros(0, np.uint64)), doc


def _by_document(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Order by document and hash: one sort of 16 bits of document and 48 of hash, unless that leaves a tie."""
    if len(doc) and doc[-1] >= 1 << 16:
        return np.lexsort((h, doc))
    key = doc.astype(np.uint64) << np.uint64(48) | h >> np.uint64(16)
    order = np.argsort(key)
    key, ranked = key[order], h[order]
    return np.lexsort((h, doc)) if ((key[1:] == key[:-1]) & (ranked[1:] != ranked[:-1])).any() else order


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct ``k``-word shingles, sorted by document and hash.

    A document with fewer words, but at least one, has its whole sequence as its only shingle;
    one without words has none.
    """
    words, doc = lower_words(data, offsets)
    if not len(words):
        return words, doc
    n_docs = len(offsets) - 1
    count = np.bincount(doc, minlength=n_docs)
    place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
    left = np.repeat(count, count) - place  # words from here to the document's end
    out = np.zeros(len(words), dtype=np.uint64)
    for i in range(k):  # in a short document, what is beyond its end adds nothing
        there = np.flatnonzero(left > i)
        out[there] = mix(out[there] * np.uint64(0x9DDFEA08EB382D69) + words[there + i] + np.uint64(i + 1))
    keep = (left >= k) | ((place == 0) & (np.repeat(count, count) < k))
    h, d = out[keep], doc[keep]
    order = _by_document(h, d)
    h, d = h[order], d[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]
