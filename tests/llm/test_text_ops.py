"""HTML extraction, SentencePiece, toxicity and the registered queries of them."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.llm import html_text, sentencepieces, toxicity

PAGES = "page_id bigint, url string, html string, text string, host string"
SITE = "http://a.example.org/news/"


def page(body, menu="Home News"):
    return f"<html><head><title>t</title></head><body><div>{menu}</div>{body}<p>All rights reserved</p></body></html>"


def test_lines_and_markup():
    got = html_text.lines_of("""<!-- x --><nav>Menu <b>now</b></nav><article><header>Top</header><h1>A &amp;amp; B</h1><p>one<br>two&nbsp; three
        <p>four <script>var t="</p>";</script>five<div class="post ad-box">buy <div>more</div> it</div><form>name</form><p>six</article><footer>end</footer>tail""")
    assert [t for t, part in got if part == 2] == ["A &amp; B", "one two three", "four five", "six"]
    assert html_text.main_text(got, set()) == "A &amp; B\none two three\nfour five\nsix"
    assert html_text.lines_of(None) == [] and html_text.lines_of("<p") != []
    assert html_text.main_text(html_text.lines_of("<div class='ad'>x<article>y</article>"), set()) == "y"


def test_shared_lines_is_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(500):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 12))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = sorted(html_text.shared_lines(a, b))
        assert len(found) == table[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_html_differencing(spark):
    rows = [(1, SITE + "a", page("<p>first story</p>"), "x", "y"), (2, SITE + "b?q=1", page("<p>second story</p><p>more</p>"), None, None),
            (3, SITE + "b", page("<p>second story</p><p>more</p>"), None, None), (4, "http://other.example.org/", page("<p>alone</p>"), None, None),
            (5, None, None, None, None), (6, "no url", "", None, None), (7, SITE + "c", page("<article><p>first story</p></article>"), None, None),
            (8, SITE + "z", page("<p>" + "long " * 30_000 + "</p>"), None, None), (1, SITE + "a", page("<p>first story</p>"), "x", "y")]
    got = {}
    for r in html_text.extract_text(spark.createDataFrame(rows, PAGES).repartition(3)).collect():
        assert got.setdefault(r.page_id, r.text) == r.text
    assert got == {1: "first story", 2: "second story\nmore", 3: "second story\nmore", 4: "Home News\nalone\nAll rights reserved",
                   5: "", 6: "", 7: "first story", 8: ("long " * 30_000).strip()}
    assert html_text.extract_text(spark.createDataFrame([], PAGES)).count() == 0


def test_html_template_inside_the_article(spark):
    """The partner decides what is template where markup cannot say; a line that both articles say stays."""
    page = lambda body, kind="article": f"<nav>Home</nav><div>News</div><{kind}>{body}<p>Share this</p></{kind}><p>About us</p><p>Imprint</p>"
    quote = "<p>As the saying goes</p>"
    rows = [(1, "http://h/a/1", page(f"<p>One has a long text of its own, which no other page repeats</p>{quote}<p>first</p>")), (2, "http://h/a/2", page(f"<p>Two has another long text of its own, which no other page has</p>{quote}<p>second</p>")), (3, "http://h/b", page("<p>Three</p>", "div")),
            (4, "http://h/c", page("<p>Four</p>", "div")), (5, "http://alone/", page("<p>Five</p>"))]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "One has a long text of its own, which no other page repeats\nAs the saying goes\nfirst", 2: "Two has another long text of its own, which no other page has\nAs the saying goes\nsecond", 3: "Three", 4: "Four", 5: "Five\nShare this"}
    for _, _, x in rows[:4]:  # without the comparison the template stays
        assert "Share this" in html_text.main_text(html_text.lines_of(x), set())


def test_html_nearest_partner_shares_leading_segments(spark):
    """Page b/1 is paired with b/2, not with the page before it in the order of paths."""
    page = lambda body, menu: f"<div>{menu}</div><div>{menu} more</div><p>{body}</p>"
    rows = [(1, "http://h/a/9", page("nine", "A")), (2, "http://h/b/1", page("one", "B")), (3, "http://h/b/2", page("two", "B"))]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[2] == "one" and got[3] == "two"


def test_html_comments_asides_and_contradicting_classes():
    text = lambda x: html_text.main_text(html_text.lines_of(x), set())
    assert text('<article><p>Body</p><section class="comments"><article class="comment">first! nice</article></section></article><aside><article>Other</article></aside>') == "Body"
    assert text('<div class="content no-sidebar header"><p>Body text</p></div><div class="ad">x</div>') == "Body text"
    assert text('<form id="page"><article><p>A</p></article></form>') == "A"
    assert text('<div class="ad">x<article><p>A<p>B<div>c</div></article></div>tail') == "A\nB\nc"


def test_html_hostile_pages_are_scanned_once():
    import time

    start = time.time()
    for x in ("<a ", "<", "<!", '<a"', "<div>", "</p>", "<p class=ad>", "<aaaa"):
        html_text.lines_of(x * 50_000)
    a, b = list(range(4000)), list(range(2, 8000, 2))
    assert html_text.shared_lines(a + [9], [-1] + b) == {*range(2, 4000, 2)}
    assert time.time() - start < 30


def test_html_corpus(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(x for x in blocks if x)


TEXTS = ["Hello  world\n a　bＡ１", "  lead trail  ", "a\tb", "ﬁ ①", "\x00x", "▁x", " ▁ ▁▁ x▁ y", "a" * 500, "中文测试。日本語テスト", "", " ", "   ",
         "\n\n", " \n ", "😀😀é" * 5, "x);\r\n  y,\r\r", None, "word " * 20_000]


def test_sentencepiece_matches_library(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit(1).alias("ids"))
    extra = spark.createDataFrame([(-1 - i, t, 0) for i, t in enumerate(TEXTS)], docs.schema)
    both = docs.unionByName(extra).repartition(4)
    out = sentencepieces.decode_pieces(sentencepieces.encode_pieces(both, path), path).collect()
    texts = {r.doc_id: r.text or "" for r in both.collect()}
    assert len(out) == len(texts)
    for r in out:
        want = model.encode(texts[r.doc_id])
        assert r.ids == want, texts[r.doc_id][:80]
        assert r.decoded == model.decode(want)
    assert sentencepieces.encode_pieces(docs.limit(0), path).count() == 0


def test_sentencepiece_long_units_by_merges():
    import public_tokenizers

    fst = sentencepieces.Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(2)
    texts = ["".join(r.choice("aeinrst▁lo") for _ in range(r.randint(1, 60))) for _ in range(400)]
    texts.sort(key=len, reverse=True)
    for t, path in zip(texts, fst.shortest_paths(texts)):
        assert path == fst.shortest_path(t) == [fst.ids[p] for p in fst.merge(t)]


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1/"
    docs = spark.read.parquet(d + "documents.parquet")
    labels = spark.read.parquet(d + "labels.parquet")
    w = toxicity.train(docs, labels)
    scored = toxicity.score_toxicity(docs, w)
    assert scored.columns == [*docs.columns, "toxicity"] and scored.count() == docs.count()
    assert np.array_equal(w, toxicity.train(docs.repartition(5), labels))
    test = scored.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxicity", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in test)
    y = np.array([r.toxic for r in test])
    p = np.array([r.toxicity for r in test])
    assert ((p >= 0.5) == y).mean() > 0.96
    assert y[p >= 0.5].mean() > 0.9 and (p[y == 1] >= 0.5).mean() > 0.8


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(i, "vile thing" if i % 4 == 1 else "nice thing", None) for i in range(400)] + [(None, None, "x"), (9000, "", None), (9001, "vile " * 30_000, None)],
                                 "doc_id bigint, text string, toxicity string")
    labels = spark.createDataFrame([(i, int(i % 4 == 1) if i < 300 else None) for i in range(400)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    assert got[1] >= 0.5 > got[2] and got[9001] >= 0.5 and got[None] == got[9000]
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0
    assert all(r.toxicity < 0.5 for r in toxicity.score_toxicity(docs, none).collect())
