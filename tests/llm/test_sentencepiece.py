import random

import pytest
import public_tokenizers
import sentencepiece
from tidewharf.llm import sentencepiece_bpe as bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return bpe.load_model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(3)
    alphabet = list("abcdeéñß ▁\n\t\r.,'<>0x12\x00") + ["ﬁ", "中", "😀", "  ", "the ", "tion", "{", "}"]
    yield from ("", " ", "   ", "▁", "a", " a", "a ", "<s></s><unk><0x0A>", "aaaaaaaaaaaaa", "=" * 999)
    for _ in range(1500):
        yield "".join(rng.choices(alphabet, k=rng.randint(1, 40)))
    for _ in range(300):
        yield "".join(chr(rng.choice((rng.randint(1, 0x2FF), rng.randint(0x400, 0xD7FF))))
                      for _ in range(rng.randint(1, 30)))
    words = ["import", "numpy", "return", "self", "0000", "----", "////", "wwww", "nevertheless"]
    for _ in range(300):
        yield "".join(rng.choices(words, k=rng.randint(1, 12)))


def test_ids_are_the_librarys(model, library):
    every = list(texts())
    ids, counts = bpe.Encoder(model).encode(every)
    ids, at = ids.tolist(), 0
    for text, n in zip(every, counts.tolist()):
        assert ids[at:at + n] == library.encode(text), repr(text)
        at += n


def test_a_long_word_and_a_full_table(model, library, monkeypatch):
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefghijklmnop", k=30_000))
    encoder = bpe.Encoder(model)
    assert encoder.encode([long])[0].tolist() == library.encode(long)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 2)
    for text in ("one two three", "four five six", "one six"):
        assert encoder.encode([text])[0].tolist() == library.encode(text)


def test_round_trip_in_spark(spark, model, library):
    rows = [(i, t) for i, t in enumerate(list(texts())[:400])] + [(None, None), (7, "x"), (7, "x")]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows],
                               "doc_id long, text string, ids string, decoded string")
    got = bpe.decode(bpe.encode(df, model), model).select("text", "ids", "decoded").collect()
    assert len(got) == len(rows)
    for text, ids, decoded in got:
        assert ids == library.encode(text or "")
        assert decoded == library.decode(ids), repr(text)
    assert bpe.decode(bpe.encode(df.limit(0), model), model).collect() == []


def test_decoding_other_ids(spark, model, library):
    rng = random.Random(5)
    every = [[rng.randrange(3, 32000) for _ in range(rng.randint(0, 9))] for _ in range(300)]
    every += [[], [1], [2], [0], [1, 264, 2], [259, 259], [28705], [0, 264]]
    df = spark.createDataFrame([(e,) for e in every] + [(None,)], "ids array<int>")
    for ids, decoded in bpe.decode(df, model).collect():
        assert decoded == library.decode(ids or []), ids


def test_other_models_are_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "is_unused", lambda *a: True)
    with pytest.raises(ValueError):
        bpe.load_model(PATH)
