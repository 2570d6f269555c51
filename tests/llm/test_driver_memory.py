"""What the driver and the workers hold while the pipeline goes from stage to stage."""

import os

import pytest

from asofkit.llm import scratch

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def resident(pid):
    with open(f"/proc/{pid}/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def test_release_gives_free_native_memory_back(spark):
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = jvm.java.util.ArrayDeque()
    for _ in range(3000):  # below the size from which the C library maps each block on its own
        held.add(jvm.java.nio.ByteBuffer.allocateDirect(100_000))
    last = held.getLast()  # at the end of what was taken, so nothing shrinks by itself
    full = resident(pid)
    held.clear()
    scratch.release(spark)
    assert last.capacity() == 100_000
    assert resident(pid) < full - 150, (full, resident(pid))


def test_encoding_takes_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "One text  of words."), (2, None), (3, ""), (None, "x\u2581 y\x01")], "doc_id bigint, text string")
    got = corpus_pipeline.encode(spark, docs, "")
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    import public_tokenizers

    path, s = public_tokenizers.path("piece_bpe_32k.model"), corpus_pipeline.sentencepieces
    one = s.round_trip(docs, path).collect()
    assert one == s.decode_pieces(s.encode_pieces(docs, path), path).collect() and len(one) == 4
