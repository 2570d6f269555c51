"""The pipeline's stages, each on its own input, and its run."""

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_dedup_ops import linked  # noqa: E402
from tests.llm.test_simple_ops import check_mix, fold  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages_follow_their_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic, exact, near, mix, encode = (f for _, f in corpus_pipeline.STAGES)
    clean = toxic(spark, docs, SF)
    assert clean.columns == docs.columns and 0.8 * docs.count() < clean.count() < docs.count()

    once = exact(spark, docs, SF)
    groups = {}
    for r in docs.collect():
        groups[fold(r.text)] = max(groups.get(fold(r.text), -1), r.doc_id)
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == sorted(groups.values())

    apart = near(spark, docs, SF)
    _, comp = linked([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert apart.columns == docs.columns and sorted(r.doc_id for r in apart.collect()) == sorted(set(comp.values()))

    mixed = mix(spark, docs, SF)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns
    sizes = corpus_pipeline.mixing.mix_sources(docs).collect()
    check_mix(sizes)
    assert copies == Counter({r.doc_id: r.copies for r in sizes if r.copies})

    ids = encode(spark, docs, SF)
    assert ids.count() == docs.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    left = {r.doc_id for r in out.collect()}
    assert 0 < len(left) < docs.count() and left <= {r.doc_id for r in docs.collect()}
