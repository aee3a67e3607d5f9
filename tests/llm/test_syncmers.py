import base64
import hashlib
import random
import struct
import time

import numpy as np
from tidewharf.llm import syncmers as sm

DOCS = "doc_id long, text string"


def plain_anchors(text):
    """Positions of closed syncmers by their definition, with the module's own hash of s-mers."""
    k = sm.INNER + sm.WINDOW - 1
    if len(text) < k:
        return [0]

    def value(piece):
        h = 0
        for c in piece:
            x = np.array([ord(c) + 1], np.uint64)
            h = (h * sm._FACTOR + int(sm._mix(x)[0])) & sm._MASK
        return int(sm._mix(np.array([h], np.uint64))[0])

    inner = [value(text[i:i + sm.INNER]) for i in range(len(text) - sm.INNER + 1)]
    found = []
    for i in range(len(text) - k + 1):
        own = inner[i:i + sm.WINDOW]
        if min(own) in (own[0], own[-1]):
            found.append(i)
    return found or [0]


def texts(seed, n=40):
    rng = random.Random(seed)
    letters = "abcdeé中😀 \n"
    return ["".join(rng.choices(letters, k=rng.choice((0, 1, 5, 22, 23, 24, 60, 200))))
            for _ in range(n)] + ["a" * 100, "ab" * 60]


def test_anchors_are_closed_syncmers():
    every = texts(1)
    positions, hashes, counts = sm.anchors(every)
    assert [p.tolist() for p in np.split(positions, np.cumsum(counts)[:-1])] == [
        plain_anchors(t) for t in every]
    for text, own in zip(every, np.split(hashes, np.cumsum(counts)[:-1])):
        assert (sm.anchors([text])[1] == own).all()


def test_anchors_do_not_depend_on_what_is_around():
    rng = random.Random(2)
    text = "".join(rng.choices("abcdefgh ", k=400))
    k = sm.INNER + sm.WINDOW - 1
    p, h, _ = sm.anchors(["xyz" * 9 + text + "uvw" * 9])
    q, g, _ = sm.anchors([text])
    inside = (p >= 27) & (p <= 27 + len(text) - k)
    assert (p[inside] - 27).tolist() == q.tolist() and h[inside].tolist() == g.tolist()
    assert np.diff(q).max() <= sm.WINDOW


def expected(docs):
    """The rows of the query without what the fingerprints decide."""
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
    rows = []
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        rows.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(rows, key=repr)


def check(spark, docs, parts):
    df = spark.createDataFrame(docs, DOCS).repartition(parts)
    got = sm.compare_with_next(df).collect()
    assert sorted(((r.id, r.n_chars, r.edited_sha256) for r in got), key=repr) == expected(docs)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault((r.n_chars, r.fingerprint), set()).add(r.id)
    return got


def test_next_documents(spark, monkeypatch):
    monkeypatch.setattr(sm, "CHUNK_CHARS", 300)
    rng = random.Random(3)
    ids = rng.sample(range(-50, 10**6), 130)
    docs = list(zip(ids, texts(4, 128)))
    check(spark, docs, 5)
    check(spark, docs + [(None, "no id " * 9), (None, None), docs[0], (docs[1][0], "another text")], 3)


def test_few_and_no_documents(spark):
    for docs in ([(7, "only one " * 9)], [(None, "x"), (None, "y")], [(1, None), (2, "")], []):
        check(spark, docs, 1)


def test_likeness(spark):
    rng = random.Random(5)
    text = ["".join(rng.choices("abcdefghij  ", k=4000)) for _ in range(20)]
    got = check(spark, list(enumerate(text)), 2)
    assert min(r.near_edited for r in got) > 0.6 and max(r.near_next for r in got) < 0.05
    same = sm.compare_with_next(spark.createDataFrame([(1, text[0]), (2, text[0])], DOCS)).collect()
    assert {r.near_next for r in same} == {1.0} and len({r.fingerprint for r in same}) == 1


def test_fingerprints_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a text " * 30, "x"), (2, None, "y")],
                               "doc_id long, text string, anchors string")
    got = {r.doc_id: r.anchors for r in sm.fingerprint(df).collect()}
    assert [a.pos for a in got[1]] == plain_anchors("a text " * 30) and len(got[2]) == 1
    assert sm.fingerprint(df.limit(0)).collect() == []


def plain_fingerprint(text):
    """Kept anchors (position, hash) by definition, anchors by the tested function."""
    positions, hashes, _ = sm.anchors([text])
    every = list(zip(positions.tolist(), hashes.tolist()))
    kept = [a for a in every if a[1] % sm.KEPT_OF == 0]
    if len(kept) < sm.LEAST_KEPT:
        kept = sorted(sorted(every, key=lambda a: a[1])[:sm.LEAST_KEPT])
    return kept


def plain_likeness(one, other):
    """Longest common subsequence of numbered hashes, by the table."""
    def numbered(hashes):
        return [(h, hashes[:i].count(h)) for i, h in enumerate(hashes)]

    a, b = numbered(one), numbered(other)
    best = [0] * (len(b) + 1)
    for x in a:
        before = best[:]
        for j, y in enumerate(b):
            best[j + 1] = before[j] + 1 if x == y else max(best[j], before[j + 1])
    return 2 * best[-1] / (len(a) + len(b))


def unpacked(fingerprint):
    """The anchors of a fingerprint."""
    data, at, position, out = base64.b64decode(fingerprint), 0, 0, []
    while at < len(data):
        shift = 0
        while True:
            position += (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                break
        out.append((position, struct.unpack(">I", data[at:at + 4])[0]))
        at += 4
    return out


def test_values_as_a_plain_version(spark):
    rng = random.Random(9)
    docs = list(enumerate(texts(10, 60) + ["".join(rng.choices("abcd ef", k=rng.randint(0, 3000))) for _ in range(30)]
                          + ["a" * 5000, "abc" * 2000]))
    got = {r.id: r for r in sm.compare_with_next(spark.createDataFrame(docs, DOCS).repartition(4)).collect()}
    for (doc_id, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        cut = len(text) // 4
        own, edited = plain_fingerprint(text), plain_fingerprint(text[:len(text) - cut] + after[:cut])
        row = got[doc_id]
        assert unpacked(row.fingerprint) == own and unpacked(row.edited_fingerprint) == edited
        hashes = [h for _, h in own]
        assert row.near_edited == plain_likeness(hashes, [h for _, h in edited])
        assert row.near_next == plain_likeness(hashes, [h for _, h in plain_fingerprint(after)])


def test_likeness_is_in_order():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = rng.integers(0, 9, rng.integers(1, 14)).astype(np.uint32)
        b = rng.integers(0, 9, rng.integers(1, 14)).astype(np.uint32)
        assert sm.likeness(a, b) == plain_likeness(a.tolist(), b.tolist())
    assert sm.likeness(np.arange(4, dtype=np.uint32), np.arange(4, dtype=np.uint32)[::-1]) == 0.25


def test_small_and_telling(spark):
    from conftest_paths import SF_DIR
    rows = sm.compare_with_next(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect()
    chars = sum(r.n_chars for r in rows)
    assert sum(len(r.fingerprint) for r in rows) < chars / 10
    assert sum(len(r.edited_fingerprint) for r in rows) < chars / 10
    assert sum(r.near_edited for r in rows) / len(rows) > 0.7
    assert sum(r.near_next for r in rows) / len(rows) < 0.01


def test_a_very_long_text(spark):
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefgh ", k=3_000_000))
    start = time.perf_counter()
    got = {r.id: r for r in sm.compare_with_next(spark.createDataFrame(
        [(1, long), (2, "ab" * 1_000_000), (3, long[:2_000_000])], DOCS)).collect()}
    assert time.perf_counter() - start < 60
    assert got[1].near_edited > 0.7 and got[3].near_next > 0.75 and got[2].n_chars == 2_000_000


def test_ranges_of_ids_without_python(spark):
    """The ids are ranged in Spark, so that only the fingerprints need Python workers."""
    rng = random.Random(7)
    ids = rng.sample(range(-(1 << 61), 1 << 61), 300) + [None, None]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], DOCS).repartition(7)
    placed = sm.in_order(docs, "doc_id", "text")
    assert "Python" not in placed._jdf.queryExecution().executedPlan().toString()
    buckets = {}
    for r in placed.collect():
        buckets.setdefault(r.bucket, ([], []))[r.extra].append(r.id)
    order = [sorted(own, key=lambda i: (i is None, i or 0)) for own, _ in
             (buckets[b] for b in sorted(buckets))]
    assert sum(order, []) == sorted(ids, key=lambda i: (i is None, i or 0)) and len(order) > 1
    assert [buckets[b][1] for b in sorted(buckets)] == [[own[0]] for own in order[1:] + order[:1]]


def test_all_anchors_are_compared_beside_the_fingerprint(spark):
    rng = random.Random(12)
    text = "".join(rng.choices("abcdefgh ", k=3000))
    # An edit that no anchor of the fingerprint sees.
    edited = next(e for e in (text[:i] + "é" + text[i + 1:] for i in range(100, 2900))
                  if plain_fingerprint(e) == plain_fingerprint(text))
    docs = list(enumerate([text, edited] + texts(13, 30)))
    got = {r.id: r for r in sm.compare_with_next(spark.createDataFrame(docs, DOCS).repartition(3)).collect()}
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1
    assert got[0].anchors_sha256 != got[1].anchors_sha256 and 0.9 < got[0].near_next_all < 1

    def every(text):
        positions, hashes, _ = sm.anchors([text])
        assert positions.tolist() == plain_anchors(text)
        data = struct.pack(f"<{len(positions)}i", *positions) + struct.pack(f"<{len(hashes)}I", *hashes)
        return hashes.tolist(), hashlib.sha256(data).hexdigest()

    for (doc_id, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        cut = len(text) // 4
        (own, digest), (other, other_digest) = every(text), every(text[:len(text) - cut] + after[:cut])
        row = got[doc_id]
        assert (row.n_anchors, row.anchors_sha256, row.edited_anchors_sha256) == (
            len(own), digest, other_digest)
        assert row.near_edited_all == plain_likeness(own, other)
        assert row.near_next_all == plain_likeness(own, every(after)[0])
