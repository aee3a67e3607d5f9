import random

from brute import contamination as brute, sha, words
from pyspark.sql import functions as F
from tidewharf.llm import decontaminate as dc

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def digest(found):
    return sorted((
        (r.doc_id, r.n_words, r.n_hit, len(r["items"]), sha(",".join(r["items"])), r.n_hit > 0)
        for r in found.collect()), key=repr)


def tables(seed=1, n=300):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "And", "zwei", "éé", "x1", "don't", "a-b", "ÀB"] + [
        f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((0, 1, 3, 9, 10, 11, 40)))))
             for i in range(25)]
    items += [(3, items[3][1]), (77, None), (None, "the of and the of and w1 w2"), (78, items[9][1])]
    docs = []
    for i in range(n):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 2)):
            text = rng.choice(items)[1] or ""
            cut = text.split()
            a = rng.randint(0, len(cut))
            parts.append(rng.choice((text, " ".join(cut[a:a + 10]), " ".join(cut[:9]))))
        docs.append((i, rng.choice((" ", "\n", "-- ")).join(parts)))
    return docs + [(5, docs[5][1]), (None, docs[6][1]), (1000, None), (1001, ""), (1002, "--- ...")], items


def test_as_brute_force(spark):
    docs, items = tables()
    found = dc.contamination(spark.createDataFrame(docs, DOCS).repartition(3),
                             spark.createDataFrame(items, ITEMS))
    assert digest(found) == sorted(brute(docs, items), key=repr)


def test_small_blocks_and_chunks_change_nothing(spark):
    docs, items = tables(2)
    index = dc.build_index(spark.createDataFrame(docs, DOCS).repartition(2), block_words=50)
    assert index.count() > 20
    asked = dc.windows(spark.createDataFrame(items, ITEMS))
    # Windows of one item may be in several chunks, so its spans are compared word by word.
    assert hit(dc.search(index, asked)) == hit(dc.search(index, asked, chunk=30))


def hit(found):
    return {(r.block, r.place, r["item"], word) for r in found.collect()
            for word in ([None] if r.begin is None else range(r.begin, r.end))}


def test_proximity(spark):
    near = 4
    docs = [(1, "alpha x beta"), (2, "beta y y alpha"), (3, "alpha y y y y beta"), (4, "alpha"),
            (5, "alpha x"), (6, "y beta")]  # the last two must not meet across documents
    found = dc.contamination(
        spark.createDataFrame(docs, DOCS).coalesce(1),
        spark.createDataFrame([(9, "alpha beta")], ITEMS), near=near)
    got = {r.doc_id: (r["items"], r.near_items) for r in found.collect()}
    plain = {}
    for doc_id, text in docs:
        at = {w: [i for i, x in enumerate(words(text)) if x == w] for w in ("alpha", "beta")}
        plain[doc_id] = ["9"] if any(
            abs(i - j) <= near for i in at["alpha"] for j in at["beta"]) else []
    assert got == {d: ([], plain[d]) for d in plain}
    assert plain[1] and plain[2] and not plain[3]


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two", 5, "x")],
                                 "doc_id long, text string, n_words int, block string")
    items = spark.createDataFrame([(1, "two")], ITEMS)
    assert digest(dc.contamination(docs, items)) == [(1, 2, 1, 1, sha("1"), True)]
    assert digest(dc.contamination(docs, items.limit(0))) == [(1, 2, 0, 0, sha(""), False)]
    assert digest(dc.contamination(docs.limit(0), items)) == []


def test_a_very_long_text(spark):
    long = "filler words " * 200_000 + "needle in this long long hay stack of very many words"
    docs = spark.createDataFrame([(1, long), (2, "needle")], DOCS)
    items = spark.createDataFrame([(7, "Needle in this long long hay stack of very many")], ITEMS)
    got = dc.contamination(docs, items).orderBy("doc_id").select(
        "n_words", "n_hit", F.size("items")).collect()
    assert [tuple(r) for r in got] == [(400_011, 10, 1), (1, 0, 0)]
