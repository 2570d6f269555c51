"""Near copies just around the threshold: few pairs are tried, and no link is lost."""

import random

import pyarrow as pa

from asofkit.llm import ngram_join
from asofkit.llm.scratch import Scratch


def _group(n: int, seed: int = 3) -> list[tuple[int, str]]:
    """Texts of 400 words, each with a few words of its own; about half of all pairs reach 0.85."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rnd.sample(range(400), rnd.choice((3, 4, 4, 5))):
            words[at] = f"x{i}_{at}"
        rows.append((i, " ".join(words)))
    return rows


def _components(rows: list[tuple[int, str]], k: int, percent: int) -> dict[int, int]:
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, t in rows for w in [t.split()]}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return {i: top(i) for i in sets}


def test_pairs_of_a_large_group_follow_its_rows(spark, monkeypatch):
    rows = _group(200) + [(1000 + i, t.replace("w", "v")) for i, t in _group(60, 5)]
    tried, save = {}, Scratch.save

    def counted(self, df, table, **options):
        out = save(self, df, table, **options)
        if table.startswith(("near", "tried")):
            tried[table] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=4, percent=85).collect()
    assert {r.doc_id: r.component_id for r in out} == _components(rows, 4, 85)
    assert sum(tried.values()) <= 12 * len(rows), tried


def test_nearest_leaves_marks_where_pairs_are_left_out():
    import numpy as np

    def batch(sizes, x=0, y=0, half=None):
        n = sum(sizes)
        gram = np.repeat(np.arange(len(sizes)), sizes)
        sig = np.random.default_rng(1).integers(0, 2, (n, 128), dtype=np.uint8)
        return pa.RecordBatch.from_arrays([
            pa.array(gram), pa.array(np.full(n, x)), pa.array(np.full(n, y)), pa.array(half or [0] * n, pa.int32()), pa.array(np.arange(n)), pa.array(np.arange(n)),
            pa.array(np.full(n, 400), pa.int32()), pa.array(np.zeros(n), pa.int32()), pa.array(np.arange(n)), pa.array([s.tobytes() for s in sig], pa.binary())],
            names=["gram", "x", "y", "half", "id", "tk", "n", "place", "g", "signature"])

    def ran(rows, nearest, size):
        parts = [rows.slice(i, size) for i in range(0, rows.num_rows, size)]
        out = pa.Table.from_batches(list(ngram_join._survivors(50, nearest)(iter(parts)))).to_pylist()
        return sorted((r["a"], r["b"]) for r in out if r["a"] is not None), {r["more"] for r in out if r["more"] is not None}

    rows = batch([1, 2, 5, 1, 3])
    every = [(a, b) for s, n in ((0, 1), (1, 2), (3, 5), (8, 1), (9, 3)) for a in range(s, s + n) for b in range(a + 1, s + n)]
    for size in (1, 2, 3, 5, 12):  # however the rows come in batches
        assert ran(rows, False, size) == (every, set())
        pairs, more = ran(rows, True, size)
        assert len(pairs) == 1 + 4 + 2 and set(pairs) <= set(every) and more == {2, 4}
    two = batch([5], x=0, y=1, half=[0, 0, 1, 1, 1])
    assert ran(two, False, 2) == ([(a, b) for a in (0, 1) for b in (2, 3, 4)], set())
