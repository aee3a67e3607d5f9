import random

import public_tokenizers
import pytest
import tiktoken
from tidewharf.llm import token_counts as tc


@pytest.fixture(scope="module")
def ranks():
    return tc.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def histogram(spark, lengths, range_size=None):
    df = spark.createDataFrame([(n,) for n in lengths], "n_tokens long")
    return tc.histogram(df)


@pytest.mark.parametrize("size", [4, 1024])
def test_histogram_answers_every_limit(spark, monkeypatch, size):
    monkeypatch.setattr(tc, "RANGE", size)
    rng = random.Random(size)
    lengths = [rng.choice((0, 1, rng.randrange(50), rng.randrange(5000))) for _ in range(700)]
    got = histogram(spark, lengths)
    total = sum(lengths)
    for r in got.collect():
        n = r.length
        longer = [x for x in lengths if x >= n]
        assert (r.n_docs, r.n_tokens) == (lengths.count(n), n * lengths.count(n))
        assert (r.docs_at_least, r.tokens_at_least) == (len(longer), sum(longer))
        assert (r.total_docs, r.total_tokens) == (len(lengths), total)
        assert r.truncated_tokens == sum(min(x, n) for x in lengths)
        assert r.share_up_to == sum(x <= n for x in lengths) / len(lengths)
    assert got.count() == len(set(lengths))
    limits = spark.createDataFrame([(0,), (3,), (777,), (10**6,), (3,), (None,)], "limit long")
    assert {tuple(r) for r in tc.at_limits(got, limits).collect()} == {
        (n, sum(x > n for x in lengths), total, sum(min(x, n) for x in lengths))
        for n in (0, 3, 777, 10**6)}
    ranked = sorted(lengths)
    shares = [0.01, 0.5, 0.9, 1.0]
    assert {r.share: r.length for r in tc.quantiles(got, shares).collect()} == {
        s: next(x for i, x in enumerate(ranked) if (i + 1) / len(ranked) >= s) for s in shares}


def test_lengths_are_the_tokenizers(spark, ranks):
    texts = ["", "the cat", "<|endoftext|>", " " * 50_000, "a" * 50_000, "é中😀\x00\n\n", "x y " * 100_000]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, None, 7), (1, "the cat", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    encoding = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={})
    got = tc.with_lengths(df, ranks, public_tokenizers.PATTERN)
    assert sorted(r.n_tokens for r in got.collect()) == sorted(
        len(encoding.encode_ordinary(t or "")) for _, t, _ in rows)


def test_no_documents(spark, ranks):
    assert histogram(spark, []).collect() == []
    empty = spark.createDataFrame([], "text string")
    assert tc.with_lengths(empty, ranks, public_tokenizers.PATTERN).collect() == []
    limits = spark.createDataFrame([(5,)], "limit long")
    assert [tuple(r) for r in tc.at_limits(histogram(spark, []), limits).collect()] == [(5, 0, 0, 0)]
