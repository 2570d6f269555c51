"""Phrase collocations against counting every n-gram."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from asofkit.llm import collocations as co


def plain(rows, threshold, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= threshold and len(p) > 1}
        covered = Counter()
        for p, a in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    covered[p[i : i + m]] = max(covered[p[i : i + m]], a)
        found = []
        for p, a in frequent.items():
            if 100 * covered[p] >= 80 * a:
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def run(spark, rows, threshold=30, top=2000, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, text string, n int, phrase string, a int")
    return sorted(tuple(r) for r in co.collocations(df, threshold, top, **more).collect())


def texts(rng, n):
    words = ["the", "The", "cat", "sat", "on", "a", "mat", "é", "x" * 40, "new", "york"]
    weights = [8, 3, 5, 2, 3, 4, 1, 1, 1, 2, 2]
    out = []
    for _ in range(n):
        body = rng.choices(words, weights, k=rng.randrange(0, 40))
        out.append((rng.choice(["en", "fr", None, "und", ""]), "".join(w + rng.choice([" ", "  ", "\t", ", ", ".\n", " \r", "\x0b", "\x0c", " \xa0 "]) for w in body)))
    return out


@pytest.mark.parametrize("top", [2000, 7])
def test_plain(spark, top):
    rows = texts(random.Random(top), 600) + [(None, None), ("en", ""), ("fr", " .,"), (None, "new york " * 50)] + [("en", "New York, new york new york")] * 40
    assert run(spark, rows, top=top) == plain(rows, 30, top)


def test_small_bitmap_and_partitions(spark):
    """A bitmap that fills up and partitions of a few bytes change nothing."""
    rows = texts(random.Random(3), 300)
    assert run(spark, rows, 5, part_bytes=2000, bitmap_bits=1 << 10) == plain(rows, 5, 2000)


def test_very_long_text(spark):
    rows = [("en", " ".join(random.Random(1).choices(["a", "b", "c"], k=400_000))), ("en", "a b")]
    assert run(spark, rows) == plain(rows, 30, 2000)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(None, None), ("en", "a b c")]) == []


def test_misra_gries_keeps_what_is_frequent():
    rng = np.random.Generator(np.random.PCG64(4))
    for threshold in (3, 30, 200):
        h = np.concatenate([rng.integers(0, 1 << 20, 40_000), np.repeat(np.arange(50) * 7919, rng.integers(1, 400, 50))]).astype(np.uint32)
        rng.shuffle(h)
        summaries = [co.summed(x) for x in np.array_split(h, 60)]
        capacity = len(h) // threshold + 1
        keys, _ = co.misra_gries(summaries, capacity)
        assert len(keys) <= capacity
        frequent = {k for k, n in Counter(h.tolist()).items() if n >= threshold}
        assert frequent <= set(keys.tolist())


def test_exact_scores(spark):
    """Counts whose products pass 64 bits stay exact in the score."""
    a, left, right = 10**14 + 7, 3 * 10**14, 5 * 10**14 + 1
    got = spark.sql(f"SELECT CAST({a}L AS DECIMAL(20, 0)) * 2000000 div (CAST({left}L AS DECIMAL(20, 0)) + {right}L) AS s").first().s
    assert got == 2_000_000 * a // (left + right)
