"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Text is folded first: lower case, look-alike letters to plain ones, and digits or
signs that stand for letters inside a word ("1d10t", "l0ser") to those letters. The
lexicon holds whole words and word beginnings with a weight each; the weights of a
text's matches, as a sum and per 1,000 characters, make the score. Matches inside an
exception phrase ("trash can") do not count.

The lexicon is learned from labelled rows: log-odds of a word or word beginning in
toxic against other rows, kept where it stays above ``LEAST_EVIDENCE`` after two
standard errors. Learning reads at most ``SAMPLE_ROWS`` labelled rows, the first in
hash order of their id; scoring reads every row.

Defined results: a null or empty text has no match and gets the score of a text
without matches; null labels and null ids are not learned from; without both labels
in the training rows the lexicon is ``SEED`` with one weight for all; a document
labelled more than once counts once for each label; equal texts get equal scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewharf.llm.common import lean

SAMPLE_ROWS = 20_000
MAX_TERMS = 5_000
LEAST_EVIDENCE = 1.5
STEM = (3, 8)

# Used where there are no labels to learn from.
SEED = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting")
SEED_WEIGHT = 5.0

EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "trash pickup",
    "clown fish", "pond scum", "soap scum", "loser bracket", "sore loser",
)

# Letters of other alphabets that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
# Signs that stand for letters inside a word.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
         "@": "a", "$": "s", "!": "i", "|": "i"}

_FOLDS = str.maketrans(
    LOOK_ALIKES
    | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}  # full-width letters
    | {chr(0xFF10 + i): chr(48 + i) for i in range(10)}  # full-width digits
    | {c: None for c in "­​‌‍⁠﻿"}  # invisible
)
_FOLDABLE = re.compile("[" + "".join(map(re.escape, map(chr, _FOLDS))) + "]")
# A sign before a letter, or digits that end a word of letters.
_SIGN = re.compile(r"[01345780@$!|]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578]+(?![\w@$!|])")
_SIGNS = str.maketrans(SIGNS)
_WORD = re.compile(r"[^\W\d_]{3,}")


def fold(text: str) -> str:
    """Lower case, look-alikes and signs inside words replaced by plain letters."""
    text = text.lower()
    if _FOLDABLE.search(text):
        text = text.translate(_FOLDS)
    return _SIGN.sub(lambda m: m[0].translate(_SIGNS), text)


@dataclass(frozen=True)
class Lexicon:
    """Weights of words and of word beginnings, and the three numbers of the score."""

    words: dict[str, float]
    stems: dict[str, float]
    bias: float
    per_sum: float
    per_length: float
    exceptions: tuple[str, ...] = EXCEPTIONS


def automaton(lexicon: Lexicon):
    """All terms and exception phrases in one Aho-Corasick automaton."""
    import ahocorasick

    found: dict[str, list[tuple[int, float, bool]]] = {}
    for term, weight in lexicon.words.items():
        found.setdefault(term, []).append((len(term), weight, True))
    for term, weight in lexicon.stems.items():
        found.setdefault(term, []).append((len(term), weight, False))
    for phrase in lexicon.exceptions:
        found.setdefault(phrase, []).append((len(phrase), -1.0, True))
    machine = ahocorasick.Automaton()
    for term, values in found.items():
        machine.add_word(term, values)
    if found:
        machine.make_automaton()
    return machine


def weight_of(text: str | None, machine) -> tuple[float, int]:
    """Sum of the weights of the words matched, each by its heaviest term, and their number."""
    if not text or not len(machine):
        return 0.0, 0
    text = fold(text)
    words: dict[int, tuple[float, int]] = {}
    excepted = []
    for last, values in machine.iter(text):
        for length, weight, whole in values:
            start = last + 1 - length
            if start and text[start - 1].isalpha():
                continue
            if whole and last + 1 < len(text) and text[last + 1].isalpha():
                continue
            if weight < 0:
                excepted.append((start, last + 1))
            elif weight > words.get(start, (0.0, 0))[0]:
                words[start] = (weight, last + 1)
    # In order of start, the furthest end of the phrases begun so far tells which words they hold.
    excepted.sort()
    kept, reach, i = [], 0, 0
    for start in sorted(words):
        weight, end = words[start]
        while i < len(excepted) and excepted[i][0] <= start:
            reach, i = max(reach, excepted[i][1]), i + 1
        if end > reach:
            kept.append(weight)
    return math.fsum(kept), len(kept)


def _features(total: float, length: int) -> tuple[float, float]:
    return math.log1p(total), math.log1p(1000.0 * total / max(length, 1))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
            terms = set()
            for word in set(_WORD.findall(fold(text or ""))):
                terms.add(word + " ")
                terms.update(word[:n] for n in range(STEM[0], min(STEM[1], len(word)) + 1))
            for term in terms:
                counts.setdefault(term, [0, 0])[label] += 1
    yield pa.RecordBatch.from_pydict({
        "term": pa.array(list(counts), pa.string()),
        "toxic": pa.array([c[1] for c in counts.values()], pa.int64()),
        "other": pa.array([c[0] for c in counts.values()], pa.int64()),
    })


def _chosen(rows) -> tuple[dict[str, float], dict[str, float]]:
    """Terms by evidence; one with a shorter kept beginning of no less evidence goes."""
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    kept: dict[str, float] = {}
    for term, weight, evidence in sorted(rows, key=lambda r: (len(r[0]), r[0])):
        plain = term.rstrip(" ")
        if any(kept.get(plain[:n], -1.0) >= evidence for n in range(STEM[0], len(plain) + 1)):
            continue
        if term.endswith(" "):
            words[plain] = weight
        else:
            stems[plain] = kept[plain] = weight
            kept[plain] = evidence
    return words, stems


def learn(
    documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS,
) -> Lexicon:
    """Lexicon and score from labelled rows; the sample and the lexicon are bounded."""
    sample = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label in (0, 1)")
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(sample_rows)
    )
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # At most sample_rows rows of two numbers are broadcast.
    rows = texts.join(F.broadcast(sample), "id").select("text", "label")
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not other:
        return Lexicon(dict.fromkeys(SEED, SEED_WEIGHT), {}, -2.0, 0.5, 0.5)
    counts = (
        rows.mapInArrow(lean(_count_terms), "term string, toxic bigint, other bigint")
        .groupBy("term")
        .agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
        .where("a >= 3")
    )
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    not_a, not_b = toxic - F.col("a") + 0.5, other - F.col("b") + 0.5
    scored = (
        counts.select("term", F.log(a * not_b / (b * not_a)).alias("weight"),
                      F.sqrt(1 / a + 1 / b + 1 / not_a + 1 / not_b).alias("error"))
        .withColumn("evidence", F.col("weight") - 2 * F.col("error"))
        .where(F.col("evidence") >= LEAST_EVIDENCE)
        .orderBy(F.desc("evidence"), "term")
        .limit(max_terms)
    )
    words, stems = _chosen([(r["term"], r["weight"], r["evidence"]) for r in scored.collect()])
    draft = Lexicon(words, stems, 0.0, 0.0, 0.0)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(draft)
        for batch in batches:
            texts = batch["text"].to_pylist()
            pairs = [_features(weight_of(t, machine)[0], len(t or "")) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "x": pa.array([p[0] for p in pairs], pa.float64()),
                "y": pa.array([p[1] for p in pairs], pa.float64()),
                "label": batch["label"],
            })

    points = rows.mapInArrow(lean(features), "x double, y double, label int").collect()
    bias, per_sum, per_length = _logistic(
        np.array([(1.0, p["x"], p["y"]) for p in sorted(points)]),
        np.array([p["label"] for p in sorted(points)], float),
    )
    return Lexicon(words, stems, bias, per_sum, per_length)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def score(
    documents: DataFrame, lexicon: Lexicon, *, text_col: str = "text",
    score_col: str = "score", matches_col: str = "n_matches",
) -> DataFrame:
    """All columns of ``documents`` with a score from 0 to 1 and the number of words matched.

    Columns of those two names are replaced.
    """
    before = documents.drop(score_col, matches_col)
    names = before.columns
    at = names.index(text_col)
    schema = T.StructType([
        *before.schema.fields,
        T.StructField(score_col, T.DoubleType()),
        T.StructField(matches_col, T.LongType()),
    ])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(lexicon)
        for batch in batches:
            scores, matches = [], []
            for text in batch.column(at):
                text = text.as_py()
                total, n = weight_of(text, machine)
                x, y = _features(total, len(text or ""))
                z = lexicon.bias + lexicon.per_sum * x + lexicon.per_length * y
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                matches.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(matches, pa.int64())],
                names=[*names, score_col, matches_col],
            )

    return before.mapInArrow(lean(scored), schema)


def training_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labelled rows to learn from: crc32 of the id as text is not divisible by 5."""
    return labels.where(~held_out(F.col(id_col)))


def held_out(id_column):
    """True for the rows kept from learning; a null id counts as held out."""
    remainder = F.crc32(id_column.cast("string").cast("binary")) % 5
    return F.coalesce(remainder == 0, F.lit(True))
