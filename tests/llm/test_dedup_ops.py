"""Suffix dedup, n-gram join and embedding near-dedup against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from asofkit.llm import embeddings, ngram_join, suffix_dedup


def components(ids, edges):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def spans_of(texts, length):
    """Brute force: every start of every string of this length."""
    seen = defaultdict(list)
    for d, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]].append((d, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for where in seen.values():
        if len(where) > 1:
            for d, p in where:
                gone[d][p : p + length] = True
    out = []
    for g in gone:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(int), [0]])))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist())))
    return out


def repeated_texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    make = lambda n: " ".join(word() for _ in range(n))
    share, line = make(40), make(12)
    texts = [None, "", "short", "a" * 300, "ab" * 100, share, share + "x", "y" + share, line, line]
    for _ in range(60):
        t = make(r.randint(5, 60))
        if r.random() < 0.5:
            t = t + (share[r.randint(0, 40) : r.randint(60, 160)] if r.random() < 0.6 else line) + make(r.randint(0, 30))
        texts.append(t)
        if r.random() < 0.3:
            texts.append(t)
        if r.random() < 0.3:
            cut = r.randint(0, len(t))
            texts.append(t[:cut] + "Z" + t[cut + 1 :])
    return texts


@pytest.mark.parametrize(("length", "group"), [(24, 2000), (40, 2), (24, 8), (5, 2000)])
def test_suffix_dedup(spark, monkeypatch, length, group):
    monkeypatch.setattr(suffix_dedup, "GROUP_IN_TASK", group)
    texts = repeated_texts()
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tk string").repartition(3)
    raw = [(t or "").encode() for t in texts]
    want = spans_of(raw, length)
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, length).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(raw):
        assert [(s.start, s.end) for s in got[i].spans] == want[i], i
        kept, at = b"", 0
        for a, b in want[i]:
            kept, at = kept + t[at:a], b
        assert bytes(got[i].kept) == kept + t[at:] and got[i].n_bytes == len(t)


def test_suffix_dedup_repeated_row_and_null_id(spark):
    rows = [(1, "abcdefgh" * 4), (1, "abcdefgh" * 4), (None, "qwertyuiopasdf"), (2, "xqwertyuiopasdf")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), 12).collect()
    assert Counter((r.doc_id, bytes(r.kept)) for r in got) == Counter({(1, b""): 2, (None, b""): 1, (2, b"x"): 1})
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string"), 12).count() == 0


@pytest.mark.parametrize("group", [256, 1])
def test_suffix_dedup_corpus(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP_IN_TASK", group)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    want = dict(zip((i for i, _ in rows), spans_of([t for _, t in rows], 400)))
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_dedup.remove_repeats(docs, 400).collect()}
    assert got == want


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def linked(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    by = defaultdict(set)
    for x, (_, s) in enumerate(sets):
        for g in s:
            by[g].add(x)
    pairs = {(min(a, b), max(a, b)) for v in by.values() if len(v) < 400 for a in v for b in v if a != b}
    edges = []
    for a, b in pairs:
        (i, s), (j, t) = sets[a], sets[b]
        both = len(s & t)
        if 100 * both >= percent * (len(s) + len(t) - both):
            edges.append((i, j))
    return {i: len(s) for i, s in sets}, components([i for i, _ in sets], edges)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(spark, k, percent):
    r = random.Random(k)
    vocab = [f"W{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, " \t"), (4, "Solo"), (5, "solo"), (6, "a b"), (7, "A  b"), (8, "a b c"), (9, "b a")]
    for g in range(25):
        base = [r.choice(vocab) for _ in range(r.randint(3, 90))]
        for _ in range(r.randint(1, 9)):
            new = list(base)
            for _ in range(r.randint(0, 4)):
                new[r.randrange(len(new))] = r.choice(vocab)
            rows.append((len(rows) + 10, " ".join(new)))
            if r.random() < 0.4:
                base = new
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, block string").repartition(3)
    n, comp = linked(rows, k, percent)
    got = ngram_join.jaccard_components(df, k, percent).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == {i: (n[i], comp[i]) for i, _ in rows}
    assert {x.doc_id for x in got if x.kept} == set(comp.values())


def test_ngram_join_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n, comp = linked([(r.doc_id, r.text) for r in docs.collect()], 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, 4, 85).collect()}
    assert got == {i: (n[i], comp[i]) for i in n}
    assert len(set(comp.values())) < len(comp)


def test_ngram_join_repeats_and_empty(spark):
    t = " ".join(map(str, range(60)))
    rows = [(3, t), (3, t), (None, t + " x"), (5, "other words only here"), (None, None)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(3, None): 2, (None, None): 2, (5, 5): 1})
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(3)
    rows, base = [], r.standard_normal((40, 16))
    for i in range(400):
        v = base[i % 40] + r.standard_normal(16) * r.choice([0.02, 0.15, 0.3, 2.0])
        rows.append((i, v.astype(np.float32).tolist(), "x"))
    rows += [(400 + i, rows[7][1], "x") for i in range(5)] + [(410, [2 * x for x in rows[7][1]], None)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0]]
    rows += [(500 + i, v, "x") for i, v in enumerate(bad)]
    got = {x.vec_id: x for x in embeddings.near_duplicates(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, vec string").repartition(3))[0].collect()}
    good = [(i, np.array(v, float)) for i, v, _ in rows if i < 500]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    c = x @ x.T
    ids = [i for i, _ in good]
    hit = (c >= 0.9) & ~np.eye(len(ids), dtype=bool)
    comp = components([i for i, *_ in rows], [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit))])
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id) == (hit[k].sum(), comp[i])
    for i in range(500, 507):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))[0].count() == 0


def test_embeddings_recall_at_threshold(spark):
    """Pairs just above the threshold among many vectors, with windows much smaller than the table."""
    r = np.random.default_rng(4)
    a = r.standard_normal((1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u = r.standard_normal(a.shape)
    u -= (u * a).sum(axis=1, keepdims=True) * a
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    b = 0.905 * a + np.sqrt(1 - 0.905**2) * u
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = embeddings.near_duplicates(df, window=64, block=512)[0].collect()
    found = sum(x.n_links > 0 for x in out)
    assert found >= 0.9 * len(rows)


def test_embeddings_group_larger_than_a_block(spark):
    """All pairs of a group of different near vectors are links, however many blocks the group fills."""
    r = np.random.default_rng(5)
    base = r.standard_normal(32)
    x = np.concatenate([base + 0.15 * r.standard_normal((1400, 32)), r.standard_normal((600, 32))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    rows, links = embeddings.near_duplicates(df, window=16, block=200)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    assert len(hit) > 900_000
    met = {(p.a, p.b) for p in links.collect()}
    assert len(met) == links.count() and met <= set(map(tuple, hit.tolist())) and len(met) >= 0.999 * len(hit)
    assert {p.component_id for p in rows.collect() if p.vec_id < 1400} == {0}


def crowded(n, pairs, seed=6):
    """A third of n vectors in a cone of pairwise cosine 0.8; some of them have a partner at 0.905."""
    r = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    cone = unit(np.sqrt(0.8) * unit(r.standard_normal(64)) + np.sqrt(0.2) * unit(r.standard_normal((n // 3, 64))))
    a, u = cone[:pairs], r.standard_normal((pairs, 64))
    u = unit(u - (u * a).sum(axis=1, keepdims=True) * a)
    return np.concatenate([cone, 0.905 * a + np.sqrt(1 - 0.905**2) * u, unit(r.standard_normal((n - n // 3 - pairs, 64)))])


def test_embeddings_recall_in_a_cone(spark, window=1):
    x = crowded(9000, 200)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    signs = embeddings.signs_for(df.selectExpr("vec_id AS id", "embedding AS vec"), len(x), 256, 0.9)
    assert signs > 0  # several passes, not the exact way
    met = {(p.a, p.b) for p in embeddings.near_duplicates(df, window=window, block=512)[1].collect()}
    hit = set(map(tuple, np.argwhere(np.triu(x @ x.T >= 0.9, 1)).tolist()))
    assert met <= hit and len(met) >= 0.98 * len(hit)


def test_embeddings_signs_follow_the_density(spark):
    """Vectors of one cone share more signs than evenly spread ones, so their buckets take more signs."""
    r = np.random.default_rng(7)
    table = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    even, cone = (embeddings.signs_for(table(x), 10**7, 256, 0.9, sample=10**7) for x in (r.standard_normal((1000, 64)), crowded(1000, 10)))
    assert 0 < even < cone
    assert embeddings.signs_for(table(r.standard_normal((5, 64))), 5, 256, 0.9) == 1  # small tables take passes too


def test_embeddings_of_extreme_size(spark):
    """Components whose squares over- or underflow have the angle that they have."""
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [1.0, 0.1]), (5, [5e-324, 5e-324]), (6, [1.7e308, 1.7e308]), (7, [-1e-200, -1e-200]), (8, [10.0, 1e-300])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))[0].collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (1, 4), 5: (4, 1), 6: (4, 1), 7: (0, 7), 8: (1, 4)}


def test_embeddings_against_all_pairs(spark):
    """The registered query on the given table, by its own passes."""
    from asofkit.llm import queries

    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    sound = [r for r in rows if r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)]
    x = np.array([r.embedding for r in sound], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = dict(zip((r.vec_id for r in sound), ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist()))
    got = {r.vec_id: r.n_links for r in queries.op1_embedding_dedup(spark, sf).collect()}
    assert sum(got.values()) >= 0.999 * sum(links.values()) and all(n <= links.get(i, 0) for i, n in got.items())
