import base64
import os
import random

import pytest
from lodespark.llm import bpe, lengths

if not os.path.exists(bpe.VOCABULARY):
    pytest.skip("no vocabulary file", allow_module_level=True)
tiktoken = pytest.importorskip("tiktoken")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def truth():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def texts():
    rng = random.Random(1)
    bits = ["the", " of", "ing", "Ünïcödé", "日本語テキスト", "🙂🙃", "  ", "\n\n", "\t", "don't", "1234567", "!!!", "$$$", "<|endoftext|>", "é", "aaaaaaaaaaaa", "\x00", "İ", "antidisestablishmentarianism", " x" * 40]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)]
    out += ["".join(rng.choice("abcdefghij eno") for _ in range(rng.randrange(200))) for _ in range(300)]
    return out + ["", " ", "a", "\n", "Hello world", "hello " * 20000, "z" * 3000]


def test_encoding_equals_the_rank_encoder(spark, truth):
    rows = list(enumerate(texts()))
    got = bpe.encode_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.token_ids == truth(rows[r.doc_id][1]) and r.n_tokens == len(r.token_ids) and r.round_trip


def test_decoding(spark):
    rows = [*enumerate(texts()), (9999, None)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {(r.doc_id, r.text) for r in bpe.decode_documents(bpe.encode_documents(docs)).collect()} == set(rows)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (3, "a a"), (3, "a a")], DOCS).selectExpr("doc_id", "text", "1 AS n_tokens", "2 AS token_ids")
    got = sorted((tuple(r) for r in bpe.encode_documents(docs).collect()), key=lambda r: r[0])
    assert got == [(1, 0, None, None), (2, 0, [], True), (3, 2, [64, 257], True), (3, 2, [64, 257], True)]
    assert bpe.encode_documents(docs.limit(0)).count() == 0
    assert lengths.length_histogram(docs.limit(0)).count() == 0


def test_histogram_equals_brute_force(spark, truth):
    rows = [*enumerate(texts()), (7777, None), (None, "a b c"), (5, "a b c")]
    sizes = [len(truth(t or "")) for _, t in rows]
    h = lengths.length_histogram(spark.createDataFrame(rows, DOCS)).cache()
    got = h.collect()
    assert {r.n_tokens for r in got} == set(sizes)
    for r in got:
        n = r.n_tokens
        assert r.docs == sizes.count(n) and r.total_docs == len(sizes) and r.total_tokens == sum(sizes)
        assert r.docs_from == sum(s >= n for s in sizes) and r.tokens_from == sum(s for s in sizes if s >= n)
        assert r.kept_tokens == sum(min(s, n) for s in sizes)
        assert r.share_upto == round(sum(s <= n for s in sizes) / len(sizes), 9)
    for limit, q in ((0, 0.1), (33, 0.5), (10**9, 0.99)):
        a = lengths.answers(h, limit, q).first()
        assert a.total_tokens == sum(sizes) and a.kept_tokens == sum(min(s, limit) for s in sizes)
        assert a.truncated_docs == sum(s > limit for s in sizes)
        assert a.quantile_tokens == min(n for n in set(sizes) if sum(s <= n for s in sizes) >= q * len(sizes) - 1e-6)
    assert tuple(lengths.answers(h.limit(0), 10).first()) == (0, 0, 0, None)
