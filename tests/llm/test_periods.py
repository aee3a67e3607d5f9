import hashlib
import random
import re
import zlib

import pytest
from conftest_paths import SF_DIR
from pyspark.sql import functions as F
from tidewharf.llm import periods
from tidewharf.llm.queries import op13_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """All maximal runs, period by period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j if j > i else i + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def echo(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def repetitive(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 15))]
        words += (unit * rng.randint(1, 6))[:rng.randint(1, 60)]
        if rng.random() < 0.3:
            words += words
    return words


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("least", [2, 5, 7, 12, 20])
def test_find_as_brute_force(seed, least):
    rng = random.Random(seed)
    texts = [repetitive(rng) for _ in range(120)]
    texts += [[rng.choice("ab") for _ in range(rng.randint(0, 90))] for _ in range(60)]
    texts += [fibonacci(n) for n in (20, 90, 150)] + [["x"] * n for n in (0, 1, 11, 12, 64, 65)]
    rng.shuffle(texts)
    counts, found, collapsed = periods.find([[w.encode() for w in t] for t in texts], least)
    assert counts.to_pylist() == [len(t) for t in texts]
    expected = [brute(t, least) for t in texts]
    assert [[(r["start"], r["length"], r["period"]) for r in rows]
            for rows in found.to_pylist()] == expected
    assert collapsed.to_pylist() == [collapse(t, r) for t, r in zip(texts, expected)]
    assert sum(map(bool, expected)) > 50


def test_query_as_brute_force(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for d in documents:
        words = echo(WORD.findall(d.text or ""), d.doc_id)
        runs = quick(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        expected.append((d.doc_id, len(runs), *top, top[1] and 1000 * top[1] // top[2],
                         sha("".join("%d,%d,%d\n" % r for r in runs)),
                         sha(collapse(words, runs)), len(words)))
    got = [tuple(r) for r in op13_periodic_runs(spark, SF_DIR).collect()]
    assert sorted(got) == sorted(expected)
    assert sum(1 for r in got if r[1]) > 50


def quick(words):
    """As brute, comparing only words that occur again (prose has no long runs of most periods)."""
    where, pairs = {}, {}
    for i, w in enumerate(words):
        where.setdefault(w, []).append(i)
    texts = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)]
    seen = {}
    for i, four in enumerate(texts):
        seen.setdefault(four, []).append(i)
    for at in seen.values():
        for x, i in enumerate(at):
            for j in at[x + 1:]:
                pairs.setdefault(j - i, i)
    found = {}
    for q in sorted(q for q in pairs if 2 * q <= len(words)):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j if j > i else i + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_nulls_empties_repeats_and_names(spark):
    text = "a b " * 20
    df = spark.createDataFrame(
        [(1, text, "r", 7, "k"), (1, text, "r", 7, "k"), (None, None, None, None, None),
         (2, "", "x", 1, "y"), (3, " \t\n", "x", 1, "y"), (4, "é\x0bé\x0c" * 9 + " z", "x", 1, "y")],
        "doc_id long, text string, runs string, __text int, __row string")
    got = sorted(periods.runs(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [(r.doc_id, r["__text"], r["__row"], r.n_words, [tuple(x) for x in r.runs], r.collapsed)
            for r in got] == [
        (1, 7, "k", 40, [(0, 40, 2)], "a b"), (1, 7, "k", 40, [(0, 40, 2)], "a b"),
        (2, 1, "y", 0, [], ""), (3, 1, "y", 0, [], ""),
        (4, 1, "y", 19, [(0, 18, 1)], "é z"), (None, None, None, 0, [], "")]
    assert periods.runs(df.limit(0)).collect() == []


def test_echo_of_odd_rows(spark):
    words = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    ids = [*range(60), -5, None]
    df = spark.createDataFrame([(i, " ".join(words)) for i in ids] + [(7, None), (10, ""), (11, "  ")],
                               "doc_id long, text string")
    got = df.select("doc_id", F.col("text").alias("before"),
                    periods.echoed(F.col("text"), F.col("doc_id")).alias("text")).collect()
    assert len(got) == 65
    for r in got:
        own = (r.before or "").split()
        assert (r.text or "").split() == (own if r.doc_id is None else echo(own, r.doc_id))


def test_a_very_long_text(spark):
    rng = random.Random(1)
    unit = [f"w{rng.randrange(10 ** 6)}" for _ in range(100_000)]
    text = " ".join(unit * 3 + ["x"] * 200_000)
    row = periods.runs(spark.createDataFrame([(text,)], "text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 300_000, 100_000), (300_000, 200_000, 1)]
    assert row.n_words == 500_000 and len(row.collapsed.split()) == 100_001
