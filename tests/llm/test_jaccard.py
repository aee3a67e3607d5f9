import random

import pytest
from brute import jaccard as brute
from tidewharf.llm import jaccard
from tidewharf.llm.components import components

DOCS = "doc_id long, text string"


def result(df):
    return sorted(((r.id, r.n, r.component) for r in jaccard.similar(df).collect()), key=repr)


def near_copies(seed, n=400, vocabulary=200):
    """Chains of edits, copies, texts around a common passage, and short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    common = [word() for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.45 and texts:
            text = list(rng.choice(texts))
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(text) + 1)
                text[at:at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
        elif kind < 0.7:
            text = [word() for _ in range(rng.randint(0, 40))] + common
        else:
            text = [word() for _ in range(rng.randint(0, 60))]
        texts.append(text)
    docs = [(i, rng.choice((" ", "\n", " \t")).join(t)) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    return docs + [(None, docs[0][1]), (docs[1][0], docs[1][1]), (docs[2][0], docs[3][1]),
                   (n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "One two"), (n + 4, "one TWO")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_brute_force(spark, seed):
    docs = near_copies(seed)
    assert result(spark.createDataFrame(docs, DOCS).repartition(4)) == sorted(
        brute(docs), key=repr)


def test_frequent_tokens_change_nothing(spark, monkeypatch):
    docs = near_copies(4)
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", 3)
    monkeypatch.setattr(jaccard, "BLOCK_COUNT", 2)
    assert result(spark.createDataFrame(docs, DOCS).repartition(2)) == sorted(
        brute(docs), key=repr)


def test_a_vertex_clash_takes_another_seed(spark, monkeypatch):
    real = jaccard._vertex
    monkeypatch.setattr(jaccard, "_vertex", lambda text, seed: (
        (7, real(text, 0)[1]) if seed == 0 else real(text, seed)))
    docs = near_copies(5, n=60)
    assert result(spark.createDataFrame(docs, DOCS)) == sorted(brute(docs), key=repr)


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 9, "x")],
                               "doc_id long, text string, n int, vertex string")
    assert result(df) == [(1, 2, 1)]
    assert result(df.limit(0)) == []
    carried = jaccard.similar(df, carry=("n", "vertex")).columns
    assert carried.count("n") == 2


def test_a_very_long_text(spark):
    rng = random.Random(8)
    long = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    docs = [(5, " ".join(long)), (3, " ".join(long[:-9])), (4, " ".join(long[:90_000]))]
    got = result(spark.createDataFrame(docs, DOCS))
    assert [c for _, _, c in got] == [3, 4, 3]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)]
    edges += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    rng.shuffle(edges)
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    assert {(r.v, r.root) for r in components(df).collect()} == {
        (v, root(v)) for v in list(parent)}
    assert components(df.limit(0)).collect() == []
