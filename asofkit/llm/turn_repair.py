"""Repair of conversation structure by Wagner-Fischer alignment with the grammar ``(s?(ua)+)?``.

A conversation of whatever roles becomes one whose roles' first letters are an optional system turn and then user
and assistant turns by pairs, or nothing. The grammar has one string for each length (0, 2, 3, 4, ...), so
the turns are aligned with the string of each feasible length: strings without a system turn are the beginnings
of ``uaua...``, those with one of ``suaua...``, and one table holds the alignments with all lengths of a kind. A
table is filled inside an Ukkonen band: a first narrow one finds an incumbent, whose cost then bounds how far from
the diagonal any alignment as cheap can lie. Among the cheapest alignments of all lengths the one whose audit
comes first in ASCII is walked out of the tables.

Edits, by their letters in the audit, with their costs: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an
empty user or assistant turn 3. A turn has at most one fault, the first of: blank (no character besides white
space), duplicate (role and text stood before) and truncated (its last character is not ``.``, ``!`` or ``?``). Blank
and duplicate turns must be deleted; a truncated one that is not costs 3.

A conversation is one row of arrays and one task aligns it, so its size is bounded by a row; tables take four
bytes for each turn and place of the band. Null roles and texts count as one space, null turn numbers come first,
a null identifier is a conversation of its own; turns of one number are ordered by role and text. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

REROLE, DELETE, INSERT, TORN = 3, 4, 3, 3
SPACE = " \t\n\x0b\f\r"
FOLLOWS = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}
#: Cost above the certain one that the first band allows.
FIRST_BAND = 9
_NEVER = 1 << 29


def faults(roles: list[str], texts: list[str]) -> str:
    """One letter per turn: b(lank), d(uplicate), t(runcated) or a dash."""
    seen, out = set(), []
    for turn in zip(roles, texts):
        core = turn[1].rstrip(SPACE)
        out.append("b" if not core else "d" if turn in seen else "t" if core[-1] not in ".!?" else "-")
        seen.add(turn)
    return "".join(out)


def _targets(system: bool, place: np.ndarray) -> np.ndarray:
    """Code of the letter at each place of the string with or without a system turn."""
    out = np.where((place % 2 == 0) ^ system, ord("u"), ord("a"))
    return np.where(place == 0, ord("s"), out) if system else out


class Band:
    """Least costs to finish, for each turn and each place of one kind of string inside a band.

    The band runs along the turns that may stay: ``offset`` is the place in the string minus the number of
    such turns so far, from ``-down`` to ``up``.
    """

    def __init__(self, letters: np.ndarray, gone: np.ndarray, torn: np.ndarray, system: bool, down: int, up: int):
        self.letters, self.gone, self.torn, self.system, self.down, self.up = letters, gone, torn, system, down, up
        n = len(letters)
        self.stay = np.concatenate([[0], np.cumsum(~gone)]).tolist()
        self.offset = np.arange(-down, up + 1)
        self.cost = np.empty((n + 1, down + up + 1), dtype=np.int32)
        place = self.stay[n] + self.offset
        ends = (place % 2 == 1) & (place > 1) if system else (place % 2 == 0) & (place >= 0)
        self.cost[n] = self._inserted(np.where(ends, 0, _NEVER), place)
        for i in range(n - 1, -1, -1):
            place, later = self.stay[i] + self.offset, self.cost[i + 1]
            if gone[i]:
                best = later + DELETE
            else:
                best = np.concatenate([[_NEVER], later[:-1] + DELETE])
                match = np.where(_targets(system, place) == letters[i], 0, REROLE) + TORN * int(torn[i])
                if system and letters[i] != ord("s"):
                    match[place == 0] = _NEVER
                best = np.minimum(best, later + match)
            self.cost[i] = self._inserted(best, place)

    def _inserted(self, best: np.ndarray, place: np.ndarray) -> np.ndarray:
        """With turns inserted before; nothing may be inserted where a system turn must stand."""
        best = np.where(place < 0, _NEVER, best)
        shifted = best + INSERT * self.offset
        out = np.minimum.accumulate(shifted[::-1])[::-1] - INSERT * self.offset
        return np.minimum(np.where((place < 0) | ((place == 0) & self.system), best, out), _NEVER)

    def at(self, i: int, place: int) -> int:
        x = place - self.stay[i] + self.down
        return int(self.cost[i, x]) if 0 <= x <= self.down + self.up and place >= 0 else _NEVER

    def audit(self) -> str:
        """The first in ASCII of the cheapest alignments' edits."""
        i, place, out, n = 0, 0, [], len(self.letters)
        while i < n or self.at(i, place):
            now = self.at(i, place)
            if i < n and DELETE + self.at(i + 1, place) == now:
                i, edit = i + 1, "D"
            elif not (self.system and place == 0) and INSERT + self.at(i, place + 1) == now:
                place, edit = place + 1, "I"
            else:
                edit = "K" if self.letters[i] == _targets(self.system, np.array([place]))[0] else "R"
                i, place = i + 1, place + 1
            out.append(edit)
        return "".join(out)


def align(initials: str, found: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of turns with these roles' first letters and faults."""
    letters = np.array([ord(c) for c in initials], dtype=np.int64)
    gone, torn = np.array([c in "bd" for c in found], dtype=bool), np.array([c == "t" for c in found], dtype=bool)
    n_torn = int(torn.sum())
    certain = DELETE * int(gone.sum()) + TORN * n_torn
    slack = FIRST_BAND
    while True:
        # An insertion costs at least INSERT more than is certain, a deletion 1 for a truncated turn, DELETE for others.
        down = slack if slack <= n_torn else n_torn + (slack - n_torn) // DELETE
        bands = [Band(letters, gone, torn, system, down, slack // INSERT) for system in (False, True)]
        cost = min(b.at(0, 0) for b in bands)
        if cost - certain <= slack:
            return cost, min(b.audit() for b in bands if b.at(0, 0) == cost)
        slack = cost - certain if cost < _NEVER else 4 * slack


_align_short = lru_cache(maxsize=1 << 16)(align)


def repaired(roles: list[str], texts: list[str], audit: str) -> list[tuple[str, str]]:
    """The turns after the edits of an audit."""
    length = len(audit) - audit.count("D")
    target = "s" * (length % 2) + "ua" * (length // 2)
    out, i = [], 0
    for edit in audit:
        if edit != "D":
            role = roles[i] if edit == "K" else NAMES[target[len(out)]]
            out.append((role, "" if edit == "I" else texts[i]))
        i += edit != "I"
    return out


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in (*_COUNTS, "audit", "repaired")}
        for rows in batch.column("turns"):
            roles, texts = [], []
            for row in rows.as_py():
                roles += [row["role"]] * row["times"]
                texts += [row["text"]] * row["times"]
            found = faults(roles, texts)
            first = "".join(r[:1] or "\0" for r in roles)
            cost, audit = (_align_short if len(first) <= 32 else align)(first, found)
            for name, letter in zip(_COUNTS, "bdt"):
                out[name].append(found.count(letter))
            out["illegal"].append(sum(a[:1] + b[:1] not in FOLLOWS for a, b in zip(roles, roles[1:])))
            out["cost"].append(cost)
            out["audit"].append(audit)
            out["repaired"].append([{"role": r, "text": t} for r, t in repaired(roles, texts, audit)])
        kinds = [pa.int64()] * len(_COUNTS) + [pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
        yield pa.record_batch([batch.column("id"), batch.column("gaps"), *[pa.array(v, k) for v, k in zip(out.values(), kinds)]],
                              names=["id", "gaps", *out])


def repair_turns(turns: DataFrame, times: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id_col, gaps, blank, duplicate, truncated, illegal, cost (long), audit, repaired.

    ``times``: how often each row stands there, one after another; with 0 it does not, yet its conversation has
    a row. ``gaps`` counts turn numbers that are missing between the least and the greatest; ``illegal``
    neighbours whose first letters are none of su, ua, au; ``repaired`` is an array of (role, text).
    """
    small_batches(turns.sparkSession)
    blank = F.lit(" ")
    row = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), blank).alias("role"),
                   F.coalesce(F.col(text_col), blank).alias("text"), (F.lit(1) if times is None else times).cast("int").alias("times"))
    told = (turns.select(F.col(id_col).alias("id"), row.alias("t")).groupBy("id")
            .agg(F.sort_array(F.collect_list(F.when(F.col("t.times") > 0, F.col("t")))).alias("turns")))
    numbers = F.expr("array_compact(turns.turn)")
    gaps = F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0)).cast("long")
    fields = ", ".join(f"{c} long" for c in _COUNTS)
    id_type = told.schema["id"].dataType.simpleString()
    found = told.select("id", gaps.alias("gaps"), "turns").mapInArrow(
        _repair, f"id {id_type}, gaps long, {fields}, audit string, repaired array<struct<role: string, text: string>>")
    return found.withColumnRenamed("id", id_col)
