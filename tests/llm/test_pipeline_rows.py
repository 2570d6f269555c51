"""The pipeline's stages on null identifiers, repeated rows, one identifier with two texts, and no rows."""

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(tag, n=30):
    return " ".join(f"{tag}{i}" for i in range(n))


ROWS = [(1, words("a")), (1, words("a")), (2, words("b")), (2, words("c")), (3, words("C")), (None, words("d")), (None, words("d")), (None, words("e")),
        (4, words("b") + " more"), (5, words("f")), (None, words("f")), (6, words("g")), (6, words("g") + " more"), (7, words("h"))]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)


def seen(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_exact_keeps_one_row_of_each_text(spark):
    best = {}
    for i, t in ROWS:
        best[t.lower()] = max(best.get(t.lower(), (-1, "")), (-1 if i is None else i, t))
    want = Counter((None if i < 0 else i, t) for i, t in best.values())
    assert seen(corpus_pipeline.drop_copies(spark, table(spark, ROWS), SF)) == want


def test_near_copies_keep_one_row_of_each_group(spark):
    got = corpus_pipeline.drop_near_copies(spark, table(spark, ROWS), SF)
    assert sorted(r.text.split()[0].lower() for r in got.collect()) == ["a0", "b0", "c0", "d0", "e0", "f0", "g0", "h0"]
    ids = {r.text.split()[0].lower(): r.doc_id for r in got.collect()}
    assert ids == {"a0": 1, "b0": 2, "c0": 2, "d0": None, "e0": None, "f0": None, "g0": 6, "h0": 7}


def test_mixing_meets_its_target(spark):
    docs = table(spark, ROWS)
    got = corpus_pipeline.mix(spark, docs, SF)
    target = corpus_pipeline.mixing.mix_sources(docs).first().target
    total = sum(len(r.text.split()) for r in got.collect())
    assert abs(total - target) <= 31 and set(seen(got)) <= set(ROWS)
    assert max(n / ROWS.count(k) for k, n in seen(got).items()) <= 2 and sum(n for (i, _), n in seen(got).items() if i is None) > 0


def test_toxicity_and_encoding_keep_rows(spark):
    assert corpus_pipeline.encode(spark, table(spark, ROWS), SF).count() == len(ROWS)
    got = seen(corpus_pipeline.drop_toxic(spark, table(spark, ROWS), SF))
    assert all(n == ROWS.count(k) for k, n in got.items())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_no_rows(spark, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, table(spark, []), SF).count() == 0
