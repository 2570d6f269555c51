"""Queries over whole tables, against brute force on a small fixture."""

import math
import re
from collections import Counter

import pytest

from asofkit import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def posts(spark, tmp_path_factory):
    """Posts of several languages and lengths, with and without lang and n_chars."""
    long = " ".join(f"word{i} tail{i % 50}" for i in range(400))
    near = " ".join(f"mot{i}" for i in range(30))
    texts = [("Silver rises today", "en"), ("silver  RISES today ", "en"), ("Größe ÄNDERT sich heute", "de"), ("größe ändert sich heute", "de"), ("白银 看空 2300", "zh"),
             ("白银 看空  2300", None), (long, "en"), (long + " ", "en"), (long + " one more", "fr"), (near, "fr"), (near + " fin", None), (None, "en"), ("", None), (None, None), ("alone here", "es")]
    rows = [(i, t, lang, f"s{i % 3}", None if i == 10 or t is None else len(t)) for i, (t, lang) in enumerate(texts)]
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    return d, {i: (" ".join(t.split()).lower() if t else "", f"s{i % 3}") for i, t, *_ in rows}


def brute_edges(posts):
    heads, out = {}, set()
    for i, (text, _) in sorted(posts.items()):
        if text and heads.setdefault(text, i) != i:
            out.add((heads[text], i, "REPOST", 1.0))
    bags = {i: Counter(re.findall("[a-z0-9]+", t)) for t, i in heads.items()}
    df = Counter(w for b in bags.values() for w in b)
    vec = {i: {w: c / sum(b.values()) * (math.log((1 + len(bags)) / (1 + df[w])) + 1) for w, c in b.items()} for i, b in bags.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    for i in vec:
        for j in vec:
            if i < j and norm[i] and norm[j]:
                sim = sum(x * vec[j].get(w, 0) for w, x in vec[i].items()) / norm[i] / norm[j]
                if round(sim, 6) >= 0.8:
                    out.add((i, j, "SAME_SOURCE" if posts[i][1] == posts[j][1] else "REPOST" if sim >= 0.999 else "SEMANTIC_SIMILAR", sim))
    return out


def test_reposts_of_every_language_and_length(spark, posts):
    d, want = posts
    edges = brute_edges(want)
    got = {(r.from_item, r.to_item, r.relation, r.similarity) for r in plans.queries()["repost_edges"](spark, d).collect()}
    assert {x[:3] for x in got} == {x[:3] for x in edges} and all(abs(x[3] - y[3]) < 1e-5 for x, y in zip(sorted(got), sorted(edges))) and {(2, 3), (4, 5), (6, 7), (6, 8), (9, 10)} <= {(a, b) for a, b, *_ in got}
    root = {i: i for i in want}
    for _ in want:
        for a, b, *_ in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.post_id: r.root for r in plans.queries()["repost_clusters"](spark, d).collect()} == root


def test_first_occurrence_of_every_post(spark, posts):
    d, want = posts
    seen, status = set(), {}
    for i, (text, _) in sorted(want.items()):
        status[i] = "DUPLICATE" if text in seen else "ACCEPTED"
        seen.add(text)
    assert {r.post_id: r.status for r in plans.queries()["first_occurrence"](spark, d).collect()} == status


def test_regimes_see_all_marks(spark):
    """The counts of a bar are those of all marks of the four hours before its close, macro ones too."""
    from asofkit.plans import adapters, research

    got = research._regimes(spark, SF).collect()
    events = adapters.table(spark, SF, "events").collect()
    marks = [(r.ts, r.event_type == "signup") for r in events if r.event_type == "signup" and r.value > 100 or r.event_type == "purchase" and r.value > 200]
    assert any(r.n_macro for r in got) and any(r.n_news for r in got)
    for r in got[:: max(1, len(got) // 200)]:
        close = r.close_time.replace(tzinfo=None)
        near = [news for at, news in marks if 0 <= (close - at).total_seconds() < 4 * 3600]
        assert (r.n_news, r.n_macro) == (sum(near), len(near) - sum(near))
