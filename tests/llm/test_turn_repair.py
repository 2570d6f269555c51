"""Conversation repair against a search over the grammar's states."""

import hashlib
import random
import zlib
from functools import lru_cache

import pyarrow.parquet as pq
import pytest

from asofkit.llm import queries, turn_repair

STEP = {("", "s"): "S", ("", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}


def plain(initials, found):
    """(cost, audit) by trying every edit from every state of the grammar."""
    @lru_cache(None)
    def best(i, state, inserted):
        tries = [(0, "")] if i == len(initials) and state in ("", "A") else []
        if inserted < 3:
            for letter in "ua":
                if (state, letter) in STEP:
                    cost, rest = best(i, STEP[state, letter], inserted + 1)
                    tries.append((cost + 3, "I" + rest))
        if i < len(initials):
            cost, rest = best(i + 1, state, 0)
            tries.append((cost + 4, "D" + rest))
            if found[i] not in "bd":
                for letter in "sua":
                    if (state, letter) in STEP and (letter == initials[i] or letter != "s"):
                        cost, rest = best(i + 1, STEP[state, letter], 0)
                        same = letter == initials[i]
                        tries.append((cost + 3 * (not same) + 3 * (found[i] == "t"), ("K" if same else "R") + rest))
        return min(tries, default=(1 << 20, ""))
    for i in range(len(initials), -1, -1):  # from the end, so that no call goes deep
        for state in ("", "S", "U", "A"):
            best(i, state, 0)
    return best(0, "", 0)


@pytest.mark.parametrize("alphabet", ["sua", "uaua-uaua", "usx\0 ", "a", "s"])
def test_align(alphabet):
    rng = random.Random(alphabet)
    for n in [*range(12)] * 12 + [25, 60]:
        initials = "".join(rng.choice(alphabet) for _ in range(n)) if n < 30 else ("ua" * n)[: n - 1] + "u"
        found = "".join(rng.choice("----btd" if n % 2 else "-t") for _ in initials)
        assert turn_repair.align(initials, found) == plain(initials, found), (initials, found)


def by_hand(rows):
    """The contract, row by row."""
    told = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        h = zlib.crc32(key.encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(c for c in text if c not in ".!?")
        if h == 4:
            role = "user"
        told.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(h, 1))
    out = {}
    for conv, turns in told.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        found, seen = [], set()
        for _, role, text in turns:
            core = text.strip(" \t\n\v\f\r")
            found.append("b" if not core else "d" if (role, text) in seen else "-" if core[-1] in ".!?" else "t")
            seen.add((role, text))
        first = [t[1][:1] for t in turns]
        cost, audit = plain(tuple(c or "\0" for c in first), tuple(found))
        numbers = [t[0] for t in turns if t[0] is not None]
        lines, i, state = [], 0, ""
        for k, edit in enumerate(audit):
            rest = sum(e != "D" for e in audit[k:])  # a string of odd length begins with a system turn
            letter = "s" if rest % 2 and state == "" else "u" if state in ("", "S", "A") else "a"
            if edit != "D":
                name = turns[i][1] if edit == "K" else {"u": "user", "a": "assistant"}[letter]
                lines.append(name + ":" + ("" if edit == "I" else turns[i][2]))
                state = STEP[state, letter]
            i += edit != "I"
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *[found.count(c) for c in "bdt"],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(spark, tmp_path, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    if extra:
        df = df.selectExpr("*", "1 as id", "'x' as turns", "2 as damage", "3 as gaps")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.op11_turn_repair(spark, str(tmp_path))
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in out.collect()} == by_hand(rows)


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r.values()) for r in pq.read_table(f"{sf}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_turn_repair(spark, sf).collect()}
    assert got == by_hand(rows)


def test_nulls_ties_long(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)]), rng.choice([None, "user", "assistant", "system", "", "tool", "üser"]),
             rng.choice([None, "", " \n", "Yes.", "No", "Well? ", "é. ", "a" * 300_000 + "!"])) for _ in range(400)]
    check(spark, tmp_path, rows + rows[:50], extra=True)


def test_long_conversation_and_dropped(spark, tmp_path):
    drop = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(drop, 0, "user", "Gone.")] + [(7000, t, "ua"[t % 2] and ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(700)]
    check(spark, tmp_path, rows)


def test_empty(spark, tmp_path):
    check(spark, tmp_path, [])
