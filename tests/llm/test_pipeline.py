"""The pipeline, stage by stage, against plain versions of what each stage decides."""

import brute
import corpus_pipeline as cp
import public_tokenizers
import pytest
import sentencepiece
import __spark_entry__ as driver
from conftest_paths import SF_DIR
from tidewharf.llm import lines, toxicity
from tidewharf.llm.common import read, saved


@pytest.fixture(scope="module")
def stages(spark):
    docs = [read(spark, SF_DIR, "documents")]
    for _, stage in cp.STAGES:
        docs.append(saved(stage(spark, docs[-1], SF_DIR), "stage"))
    return [{r.doc_id: r for r in d.collect()} for d in docs]


def test_columns_are_kept(spark, stages):
    names = read(spark, SF_DIR, "documents").columns
    assert cp.COLUMNS == names
    for rows in stages[1:-1]:
        assert list(next(iter(rows.values())).asDict()) == names


def test_toxic_documents_go(spark, stages):
    before, after = stages[0], stages[1]
    labels = read(spark, SF_DIR, "labels")
    lexicon = toxicity.learn(read(spark, SF_DIR, "documents"), toxicity.training_rows(labels))
    scores = {r.doc_id: r.score for r in toxicity.score(
        read(spark, SF_DIR, "documents"), lexicon).collect()}
    assert set(after) == {i for i in before if scores[i] < 0.5}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    right = sum((i in after) == (t == 0) for i, t in toxic.items())
    assert right / len(toxic) > 0.95


def test_boilerplate_lines_go(stages):
    before, after = stages[1], stages[2]
    bad = brute.boilerplate([(r.text, r.source) for r in before.values()],
                            lines.MIN_SITES, lines.MIN_CONTEXTS)
    assert bad and {i: r.text for i, r in after.items()} == {
        i: brute.without_lines(r.text, bad) for i, r in before.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_one_of_each_group_stays(stages):
    before, after = stages[2], stages[3]
    kept = {c if n else i for i, n, c in brute.jaccard([(r.doc_id, r.text) for r in before.values()])}
    assert set(after) == kept and len(kept) < len(before)


def test_contaminated_documents_go(spark, stages):
    before, after = stages[3], stages[4]
    items = [(r.item_id, r.text) for r in read(spark, SF_DIR, "benchmark").collect()]
    found = brute.contamination([(r.doc_id, r.text) for r in before.values()], items)
    assert set(after) == {row[0] for row in found if not row[-1]} and len(after) < len(before)


def test_tokens(stages):
    before, after = stages[4], stages[5]
    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(before) == set(after)
    for i, r in after.items():
        assert r.ids == library.encode(before[i].text) and r.decoded == library.decode(r.ids)


def test_run_and_registration(spark, stages):
    assert driver.queries()["pipeline"] is cp.run and 4 <= len(cp.STAGES) <= 5
    assert {r.doc_id for r in cp.run(spark, SF_DIR).collect()} == set(stages[-1])


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", None, 0),
            (None, "some words of text here", "en", "a", 23), (4, "some words of text here", "en", "b", 23),
            (4, "some words of text here", "en", "b", 23)]
    for name, data in (("documents", rows), ("empty/documents", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for folder in (tmp_path, tmp_path / "empty"):
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
            f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(
            f"{folder}/benchmark.parquet")
    got = sorted(((r.doc_id, r.text, r.ids == []) for r in cp.run(spark, str(tmp_path)).collect()),
                 key=repr)
    assert got == sorted([(1, None, True), (1, None, True), (None, "", True),
                          (4, "some words of text here", False)], key=repr)
    assert cp.run(spark, f"{tmp_path}/empty").collect() == []
