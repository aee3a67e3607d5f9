import random

import pytest
from brute import boilerplate, without_lines
from compare import connect, differences
from conftest_paths import SF_DIR
from pyspark.sql import functions as F
from tidewharf.llm import lines

SCHEMA = "doc_id long, text string, source string"


def corpus(seed, n=300):
    rng = random.Random(seed)
    common = [f"common line {i}" for i in range(6)]
    docs = []
    for i in range(n):
        own = [f"own {rng.randrange(1500)}" for _ in range(rng.randint(0, 4))]
        own += rng.sample(common, rng.randint(0, 3)) + rng.choice(([], ["", "  "], [" common line 0\t"]))
        rng.shuffle(own)
        docs.append((i, "\n".join(own), rng.choice(("a", "b", "c", "d", "e", None))))
    docs += [(1000 + i, docs[0][1], rng.choice("abcdefgh")) for i in range(60)]  # copies
    return docs + [(None, "own 1\r\ncommon line 1", "x"), (5, docs[5][1], docs[5][2]),
                   (2000, None, "a"), (2001, "", "b"), (2002, "common line 2", "a")]


@pytest.mark.parametrize("seed, sites, contexts", [(1, 3, 10), (2, 5, 20), (3, 6, 40), (4, 2, 2)])
def test_as_brute_force(spark, seed, sites, contexts):
    docs = corpus(seed)
    bad = boilerplate([(t, s or "") for _, t, s in docs], sites, contexts)
    got = lines.remove_boilerplate(spark.createDataFrame(docs, SCHEMA).repartition(3),
                                   min_sites=sites, min_contexts=contexts)
    expected = [(i, without_lines(t, bad)) for i, t, _ in docs]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(
        expected, key=repr)
    assert bad


def test_copies_do_not_make_boilerplate(spark):
    docs = [(i, "one line\nanother line", f"s{i % 9}") for i in range(90)]
    got = lines.remove_boilerplate(spark.createDataFrame(docs, SCHEMA))
    assert {r.n_removed for r in got.collect()} == {0}


def test_sketches_far_from_the_threshold(spark):
    docs = [(i, f"everywhere\nown {i}", f"site {i % 500}") for i in range(3000)]
    got = lines.remove_boilerplate(spark.createDataFrame(docs, SCHEMA))
    assert {(r.n_lines, r.n_removed) for r in got.collect()} == {(2, 1)}


def test_as_the_oracle(spark):
    got = lines.remove_boilerplate(spark.read.parquet(f"{SF_DIR}/documents.parquet").select(
        "doc_id", "text", "source")).drop("source")
    assert differences(connect(SF_DIR), got, lines.ORACLE_SQL) == []


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "x", "a", 4, "k")],
                               "doc_id long, text string, source string, n_lines int, line string")
    assert [tuple(r) for r in lines.remove_boilerplate(df).select(
        "doc_id", "text", "line", "n_lines", "n_removed").collect()] == [(1, "x", "k", 1, 0)]
    assert lines.remove_boilerplate(df.limit(0)).collect() == []


def test_a_very_long_text(spark):
    long = "\n".join(f"line {i}" for i in range(100_000))
    docs = [(1, long, "a"), (2, "line 5\nx", "b")]
    got = lines.remove_boilerplate(spark.createDataFrame(docs, SCHEMA), min_sites=2, min_contexts=2)
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in got.collect()) == [
        (1, 100_000, 1), (2, 2, 1)]


def removed(spark, docs, **settings):
    """How many lines each document loses, by id."""
    got = lines.remove_boilerplate(spark.createDataFrame(docs, SCHEMA).repartition(4), **settings)
    return {r.doc_id: r.n_removed for r in got.collect()}


def test_a_template_of_many_lines(spark):
    template = [f"template line {i}" for i in range(20)]
    docs = [(i, "\n".join(template[:10] + [f"own {i} {j}" for j in range(5)] + template[10:]), f"s{i % 60}")
            for i in range(600)]
    assert set(removed(spark, docs).values()) == {20}


@pytest.mark.parametrize("copies", [0, 40, 60, 1000])
def test_copies_of_a_page_do_not_hide_a_line(spark, copies):
    docs = [(i, f"the line\nown {i}\nmore {i}", f"s{i % 50}") for i in range(50)]
    docs += [(1000 + i, "the line\na page\ncopied", f"s{i % 7}") for i in range(copies)]
    assert set(removed(spark, docs).values()) == {1}


def test_edited_copies_do_not_make_boilerplate(spark):
    page = [f"line {i} of a text" for i in range(30)]
    docs = [(i, "\n".join([*page[:i % 30], f"edit {i}", *page[i % 30 + 1:]]), f"s{i % 20}") for i in range(200)]
    assert set(removed(spark, docs).values()) == {0}


def test_edited_copies_of_a_text_of_few_lines(spark):
    """One word of one of three lines is another in every copy; what is common is no boilerplate."""
    rng = random.Random(8)
    page = [[f"w{rng.randrange(500)}" for _ in range(40)] for _ in range(3)]
    docs = []
    for i in range(300):
        copy = [list(line) for line in page]
        copy[rng.randrange(3)][rng.randrange(40)] = f"edit{i}"
        docs.append((i, "\n".join(map(" ".join, copy)), f"s{i % 20}"))
    assert set(removed(spark, docs).values()) == {0}


def test_names_that_were_used_inside(spark):
    df = spark.createDataFrame([(i, f"everywhere\nown {i}", f"s{i}", f"k{i}", i, {"a": i}) for i in range(30)],
                               "doc_id long, text string, source string, __key string, __drop int, row map<string,int>")
    df = df.withColumn("text_key", F.lit("t")).withColumn("drop", F.lit("d"))
    got = lines.remove_boilerplate(df).orderBy("doc_id").collect()
    assert [(r["__key"], r["__drop"], r["row"], r["text_key"], r["drop"], r.text) for r in got] == [
        (f"k{i}", i, {"a": i}, "t", "d", f"own {i}") for i in range(30)]


def test_pairs_of_words_are_hashed_once_for_all_copies(spark):
    docs = spark.createDataFrame([(i, "shared\nown words of it", f"s{i}") for i in range(9)], SCHEMA)
    spread = docs.select(F.md5(F.lit("shared")).alias("line")).distinct()
    texts = lines._spread_in_texts(docs, "text", spread)
    plan = texts._jdf.queryExecution().optimizedPlan().toString().splitlines()
    paired = next(i for i, row in enumerate(plan) if "slice(" in row)
    grouped = next(i for i, row in enumerate(plan) if "Aggregate [text_key" in row)
    assert paired < grouped  # from the top down, so on the grouped texts
    assert texts.count() == 1
