import random

import pytest
from brute import identifiers
from tidewharf.llm.pii import KINDS, all_spans, detect, plain_spans


def test_base_spans_are_the_patterns_matches():
    rng = random.Random(7)
    parts = ["a@b.co", "x.y+z@mail-1.example.com", "@", ".", "..", "+", "1", "255", "256", "00",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-2671", "10.0.0.1", " ",
             "-", "(", ")", "é", "\n", "word", "%", "4532015112830366", "1.2.3.4.5.6.7.8", "  "]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert plain_spans(text) == identifiers(text), text


@pytest.mark.parametrize("text, kind, piece", [
    ("write jane.doe [at] mail [dot] example [dot] com now", "email",
     "jane.doe [at] mail [dot] example [dot] com"),
    ("write jane(at)example.org today", "email", "jane(at)example.org"),
    ("jane at example dot com", "email", "jane at example dot com"),
    ("mail jаne@exаmple.com!", "email", "jаne@exаmple.com"),
    ("host １０.0.0.７ is up", "ip", "１０.0.0.７"),
    ("host 10 dot 0 dot 0 dot 7 is up", "ip", "10 dot 0 dot 0 dot 7"),
    ("call plus one four one five five five five two six seven one", "phone",
     "plus one four one five five five five two six seven one"),
    ("é call +1 4​15 555 2671", "phone", "+1 4​15 555 2671"),
    ("four one one one 1111 1111 1111 eins", "card", None),
    ("four one one one 1111 1111 1112", "card", None),  # the check digit is wrong
    ("four five three two 0151 1283 0366 ok", "card", "four five three two 0151 1283 0366"),
])
def test_disguised(text, kind, piece):
    added = [(KINDS[k], text[a:b]) for a, k, b, base in all_spans(text) if not base]
    assert added == ([(kind, piece)] if piece else [])


def test_plain_prose_gets_no_spans():
    for text in ("We met at noon (at home) and the dot was red.", "un dos tres cuatro cinco",
                 "at the point of two or three", "one two three"):
        assert all_spans(text) == []


def test_added_spans_do_not_overlap_base_spans():
    text = "a@b.com x [at] y [dot] org"
    assert [(text[a:b], base) for a, _, b, base in all_spans(text)] == [
        ("a@b.com", True), ("x [at] y [dot] org", False)]


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "a@" * 100_000, "+1 " * 100_000,
                 "one " * 50_000, "[at] " * 50_000):
        all_spans(text)


def test_detect_handles_nulls_and_clashing_columns(spark):
    rows = [(1, None, "x"), (None, "", None), (3, "a@b.co", "y"), (3, "a@b.co", "y")]
    found = detect(spark.createDataFrame(rows, "doc_id long, text string, spans string"))
    assert sorted((r.doc_id or 0, [(s.kind, s.start, s.end) for s in r.spans])
                  for r in found.collect()) == [
        (0, []), (1, []), (3, [("email", 0, 6)]), (3, [("email", 0, 6)])]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert detect(empty).collect() == []


@pytest.mark.parametrize("text, kind, piece", [
    ("call +1 415 555 26 seven one now", "phone", "+1 415 555 26 seven one"),
    ("call +1 415 555 26 one, please", "phone", "+1 415 555 26 one"),
    ("card five 4 2 4 two 4 2 4 2 4 2 4 2 4 2 4 2, ok", "card", None),  # 17 digits, Luhn fails
    ("card four 2 4 2 four 2 4 2 4 2 4 2 4 2 4 2, ok", "card",
     "four 2 4 2 four 2 4 2 4 2 4 2 4 2 4 2"),
    ("from 2019 2020 2021 2022 one by one", "card", None),
])
def test_few_or_scattered_spelled_digits(text, kind, piece):
    added = [(KINDS[k], text[a:b]) for a, k, b, base in all_spans(text) if not base]
    assert added == ([(kind, piece)] if piece else [])


@pytest.mark.parametrize("text, kind, piece", [
    ("jоhn@example.com", "email", "jоhn@example.com"),
    ("to mary.jоnes@example.org now", "email", "mary.jоnes@example.org"),
    ("at one nine two dot one six eight dot one dot one there", "ip",
     "one nine two dot one six eight dot one dot one"),
    ("+1 four one five, five five five, two six seven one!", "phone",
     "+1 four one five, five five five, two six seven one"),
    ("+1 four one five triple five two six seven one", "phone", "+1 four one five triple five two six seven one"),
    ("ring +1 4l5 555 267l today", "phone", "+1 4l5 555 267l"),
    ("ring +1 4O5 555 O671 today", "phone", "+1 4O5 555 O671"),
    ("𝐣𝐨𝐡𝐧@example.com", "email", "𝐣𝐨𝐡𝐧@example.com"),
    ("jo\u04bbn@example.com", "email", "jo\u04bbn@example.com"),
    ("+१ ४१५ ५५५ २६७१", "phone", "+१ ४१५ ५५५ २६७१"),
    ("+¹ ⁴¹⁵ ⁵⁵⁵ ²⁶⁷¹", "phone", "+¹ ⁴¹⁵ ⁵⁵⁵ ²⁶⁷¹"),
    ("john at example.com wrote", "email", "john at example.com"),
    ("john at mail.example.co.uk wrote", "email", "john at mail.example.co.uk"),
    ("we met at noon.Then we left at home.", "email", None),
    ("Plan B5l and lO in room 1O1", "phone", None),
    ("one, two, three and four, five", "card", None),
])
def test_more_disguises(text, kind, piece):
    added = [(KINDS[k], text[a:b]) for a, k, b, base in all_spans(text) if not base]
    assert added == ([(kind, piece)] if piece else [])


def test_base_spans_stay_beside_longer_ones():
    text = "jоhn@example.com"
    assert [(a, KINDS[k], b, base) for a, k, b, base in all_spans(text)] == [
        (0, "email", 16, False), (2, "email", 16, True)]
