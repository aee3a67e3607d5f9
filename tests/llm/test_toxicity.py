import random
import zlib

from tidewharf.llm import toxicity as tox


def test_folding():
    assert tox.fold("1D10T") == "idiot" and tox.fold("lоser") == "loser"
    assert tox.fold("ｓｔｕｐｉｄ") == "stupid" and tox.fold("mo​ron") == "moron"
    assert tox.fold("idiot$$$ the%%%") == "idiot$$$ the%%%" and tox.fold("10.0.0.1") == "10.0.0.1"
    assert tox.fold("") == ""


def test_matches_are_those_of_a_plain_search():
    lexicon = tox.Lexicon({"trash": 2.0, "idiot": 3.0, "idiotic": 1.0}, {"lowei": 4.0, "idi": 0.5},
                          0, 0, 0)
    machine = tox.automaton(lexicon)
    cases = {
        "you idiot": 3.0, "idiots": 0.5, "IDIOTIC": 1.0, "trash": 2.0, "the trash can": 0.0,
        "the trash can of trash": 2.0, "loweient": 4.0, "xlowei": 0.0, "1d10t!": 3.0, "": 0.0,
        "idiot idiot": 6.0, "thrash": 0.0,
    }
    for text, weight in cases.items():
        assert tox.weight_of(text, machine)[0] == weight, text
    assert tox.weight_of(None, machine) == (0.0, 0)
    assert tox.weight_of("x", tox.automaton(tox.Lexicon({}, {}, 0, 0, 0, ()))) == (0.0, 0)


def corpus(n=1200):
    rng = random.Random(4)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    bad = ["blarg", "quzzle", "vexatron"]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        text = rng.choices(plain, k=rng.randint(5, 80))
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(("", "s", "ing")))
        docs.append((i, " ".join(text)))
        if rng.random() < 0.8:
            labels.append((i, int(toxic != (rng.random() < 0.03))))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    labelled = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = tox.learn(documents, tox.training_rows(labelled))
    got = {r.doc_id: r for r in tox.score(documents, lexicon).collect()}
    assert all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].score >= 0.5, t == 1) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.93
    assert not any(zlib.crc32(str(r.doc_id).encode()) % 5 == 0
                   for r in tox.training_rows(labelled).collect() if r.doc_id is not None)


def test_without_labels_and_with_odd_rows(spark):
    documents = spark.createDataFrame(
        [(1, None, "x"), (2, "", "y"), (None, "you stupid idiot", "z"), (3, "fine " * 100_000, "z")],
        "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = tox.learn(documents, none)
    got = {r.doc_id: (r.score >= 0.5, r.n_matches) for r in tox.score(documents, lexicon).collect()}
    assert got == {1: (False, 0), 2: (False, 0), None: (True, 2), 3: (False, 0)}
    assert tox.score(documents.limit(0), lexicon).collect() == []


def test_exceptions_in_one_sweep():
    """As holding every word against every phrase, and quick for many of both."""
    import random
    import time

    from tidewharf.llm.toxicity import Lexicon, automaton, weight_of
    rng = random.Random(3)
    machine = automaton(Lexicon({"trash": 2.0, "can": 1.0}, {"gar": 4.0}, 0.0, 1.0, 1.0, ("trash can", "can gar", "a can")))
    for _ in range(300):
        words = [rng.choice(["trash", "can", "gar", "garden", "a", "x"]) for _ in range(rng.randint(0, 12))]
        spans, at = [], 0
        for w in words:
            spans.append((at, at + len(w), w))
            at += len(w) + 1
        text = " ".join(words)
        free = []
        for i, (start, end, w) in enumerate(spans):
            weight = {"trash": 2.0, "can": 1.0, "gar": 4.0, "garden": 4.0}.get(w)
            term_end = start + 3 if w == "garden" else end
            held = any(text.startswith(p, a) and a <= start and term_end <= a + len(p)
                       and not text[a + len(p):a + len(p) + 1].isalpha()
                       for a, _, _ in spans for p in ("trash can", "can gar", "a can"))
            if weight and not held:
                free.append(weight)
        assert weight_of(text, machine) == (sum(free), len(free))
    begin = time.perf_counter()
    assert weight_of("trash can " * 100_000, machine) == (0.0, 0)
    assert time.perf_counter() - begin < 3
