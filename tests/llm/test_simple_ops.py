"""Exact dedup, token files, chat formatting and mixing against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.llm import chat, exact_dedup, mixing, token_io
from asofkit.llm.scratch import Scratch

DOCS = "doc_id bigint, text string, source string, digest string, t string, size int, id string"
TEXTS = ["Abc d", "aBC D", None, "", "É", "é", "x" * 50_000, "\t a\n b ", "a  b", "a 　b  c", "<|endoftext|> it's 12", "Abc d"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}" if i % 5 else None, "clash", None, 7, "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, "abc d", None, None, None, None, None)], DOCS)


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda t: F.substring(t, 1, 1).cast("binary")])
def test_exact_dedup(docs, digest):
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[fold(r.text)].append(r.doc_id)
    want = Counter()
    for g in groups.values():
        top = max((i for i in g if i is not None), default=None)
        want.update((i, top, len(g)) for i in g)
    got = exact_dedup.exact_dedup(docs, digest=digest).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_token_files(spark, docs, n):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = Scratch(spark, "test").path("ids")
    token_io.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), partitions=n)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_io.token_digests(spark, path).collect())
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    at, want = 0, []
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((at, r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_token_files_match_library_on_corpus(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = Scratch(spark, "test").path("ids")
    token_io.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want = {i: e.ids + [0] for (i, _), e in zip(rows, t.encode_batch([x for _, x in rows], add_special_tokens=False))}
    assert {r.doc_id: r.tokens for r in token_io.read_tokens(spark, path).collect()} == want


@pytest.mark.parametrize("plain", [False, True])
def test_token_files_special_strings(spark, plain):
    """Special strings come out as the plain library gives them, or as text where that is asked for."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = plain
    texts = ["a <|endoftext|> b", "<|endoftext|>", "no mark", None, "x<|endoftext|><|endoftext|>\n y", "<|endoftext"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    path = Scratch(spark, "test").path("ids")
    token_io.write_tokens(df, path, public_tokenizers.path("byte_bpe_50k.json"), plain_specials=plain)
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in enumerate(texts)}
    assert {r.doc_id: r.tokens for r in token_io.read_tokens(spark, path).collect()} == want


def test_token_files_empty(spark):
    import public_tokenizers

    path = Scratch(spark, "test").path("ids")
    token_io.write_tokens(spark.createDataFrame([], DOCS), path, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_io.token_digests(spark, path).count() == 0


TURNS = [(1, 0, "user", "a"), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 2, "assistant", "\\b\\l<then/>\n"),
         (1, 3, "user", None), (2, 0, None, "x"), (2, None, "as: <#", "y"), (None, 0, "assistant", ""), (None, 0, "assistant", ""),
         (3, 1, "assistant", "é😀" * 3000), (3, 0, "assistant", "q")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame([(*r, "clash") for r in TURNS], "conv_id bigint, turn bigint, role string, text string, turns string")
    out = chat.format_chats(df)
    back = {r.conv_id: r for r in chat.chat_digests(out).collect()}
    by = defaultdict(list)
    for c, t, role, text in TURNS:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(back) == set(by)
    for r in out.collect():
        want = [x[2:] for x in sorted(by[r.conv_id])]
        b = back[r.conv_id]
        assert b.n_turns == len(want) and b.formatted_chars == len(r.formatted)
        assert b.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in want).encode()).hexdigest()
        loss = "".join(t for a, t in want if a == "assistant")
        assert (b.loss_chars, b.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        at, learnt = 0, ""
        for run in r.loss_runs:
            learnt += r.formatted[at : at + run.n_chars] * run.learn
            at += run.n_chars
        assert at == len(r.formatted)
        assert learnt.replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\") == loss
        assert r.formatted.count("### ") == 1 + sum(x[0] != y[0] for x, y in zip(want, want[1:]))


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.chat_digests(chat.format_chats(df)).count() == 0


def water_fill(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while free:
        rate = left / sum(w[s] for s in free)
        over = {s for s in free if rate * w[s] > most * sizes[s]}
        if not over:
            target |= {s: rate * w[s] for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def check_mix(rows):
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    target = water_fill(sizes, (5, 2, 1), 1.5, 2.0)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s] + 1e-6


def test_mixing(spark, docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    check_mix(rows)


def test_mixing_corpus_and_rerun(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    check_mix(rows)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_mixing_empty(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0
