"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

Texts are cut into words that no piece can cross. The distinct words of a chunk that are
not known yet become one flat array of symbols. In each round every word finds the least
rank among its neighbouring pairs and merges there, all words at once: the leftmost such
pair, or all such pairs from the left where that gives the same result. Words without a
pair leave the array. Known words keep their ids in a bounded table.

The model is read on the driver and sent to the tasks as bytes. Only byte-pair models with
byte fallback, identity normalisation and a space put before the text are taken, others
raise ValueError.

Defined results: a null or empty text has no ids and decodes to an empty text; decoding no
or null ids gives an empty text; equal texts have equal ids. A text of any length is encoded
whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewharf.llm.common import lean, lists, ranges

SPACE = "▁"
#: Words whose ids a task keeps; then it starts anew.
KNOWN_WORDS = 1 << 17
#: Characters of texts that are encoded together.
CHUNK_CHARS = 1 << 20
NO_RANK = np.int32(2**31 - 1)


@dataclass(frozen=True)
class Model:
    """Pieces, and the pairs of symbols that merge.

    Symbols are ids of pieces, then characters that are in pieces without being one.
    ``keys`` (left symbol, right symbol) is sorted; ``merged`` and ``rank`` go with it.
    """

    pieces: list[str]
    kinds: np.ndarray  # 0 plain, 1 byte, 2 control, 3 unknown
    symbols: dict[str, int]
    keys: np.ndarray
    merged: np.ndarray
    rank: np.ndarray
    safe: np.ndarray
    byte_ids: np.ndarray


def load_model(path: str) -> Model:
    import sentencepiece

    with open(path, "rb") as file:
        model = sentencepiece.SentencePieceProcessor(model_proto=file.read())
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    kinds = np.array([
        1 if model.is_byte(i) else 2 if model.is_control(i) else 3 if model.is_unknown(i) else 0
        for i in range(n)], np.int8)
    plain = {pieces[i]: i for i in range(n) if not kinds[i]}
    if (int((kinds == 1).sum()) != 256 or any(model.is_unused(i) for i in range(n))
            or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in plain)
            or model.encode(" a  b ", out_type=str)[0][0] != SPACE
            or model.decode(model.encode(" a  ﬁ ")) != " a  ﬁ "):
        raise ValueError(f"{path}: not a byte-pair model of the kind that this encoder takes")
    symbols = dict(plain)
    for piece in plain:
        for char in piece:
            symbols.setdefault(char, n + len(symbols) - len(plain))
    scores = {piece: model.get_score(i) for piece, i in plain.items()}
    ranks = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
    pairs, best_around = [], {}
    for piece, i in plain.items():
        rank = ranks[scores[piece]]
        for cut in range(1, len(piece)):
            for part in (piece[:cut], piece[cut:]):
                best_around[part] = min(best_around.get(part, n), rank)
            left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
            if left is not None and right is not None:
                pairs.append((left << 32 | right, i, rank))
    pairs.sort()
    # A merge may be done in several places at once if no better pair can follow from it.
    safe = [best_around.get(piece, n) > ranks[scores[piece]] if not kinds[i] else True
            for i, piece in enumerate(pieces)]
    return Model(
        pieces, kinds, symbols, *(np.array(column, np.int64) for column in zip(*pairs)),
        np.array(safe), np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32))


def _pair_up(model: Model, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each pair (``NO_RANK`` if it does not merge) and the symbol it merges to."""
    key = (left.astype(np.int64) << 32) | right
    at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
    found = (model.keys[at] == key) & (left >= 0) & (right >= 0)
    return (np.where(found, model.rank[at], NO_RANK).astype(np.int32),
            np.where(found, model.merged[at], -1).astype(np.int32))


def merge_rounds(model: Model, symbols: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge until no pair is left: the symbols, their words, and how many symbols each took up.

    ``words`` numbers the word of each symbol, in order; a symbol below zero never merges.
    """
    place = np.arange(len(symbols))
    done: list[tuple[np.ndarray, ...]] = []
    rank, target = _ranks(model, symbols, words)
    while len(symbols):
        first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        least = np.minimum.reduceat(rank, first)
        sizes = np.diff(first, append=len(words))
        alive = np.repeat(least < NO_RANK, sizes)
        if not alive.all():
            done.append((symbols[~alive], words[~alive], place[~alive]))
            symbols, words, place, rank, target = (
                x[alive] for x in (symbols, words, place, rank, target))
            sizes, least = sizes[least < NO_RANK], least[least < NO_RANK]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == np.repeat(least, sizes))
        chosen = _from_left(at, words[at], model.safe[target[at]])
        symbols[chosen] = target[chosen]
        keep = np.ones(len(symbols), bool)
        keep[chosen + 1] = False
        now = np.cumsum(keep) - 1
        symbols, words, place, rank, target = (
            x[keep] for x in (symbols, words, place, rank, target))
        changed = now[chosen]
        changed = np.unique(np.concatenate((changed, np.maximum(changed - 1, 0))))
        rank[changed], target[changed] = _ranks(model, symbols, words, changed)
    if not done:
        return symbols, words, place
    symbols, words, place = (np.concatenate(column) for column in zip(*done))
    order = np.argsort(place, kind="stable")
    return symbols[order], words[order], place[order]


def _ranks(model: Model, symbols: np.ndarray, words: np.ndarray, at: np.ndarray | None = None):
    """Rank and result of the pair that begins at each place."""
    at = np.arange(len(symbols)) if at is None else at
    after = np.minimum(at + 1, len(symbols) - 1)
    rank, target = _pair_up(model, symbols[at], symbols[after])
    alone = (after == at) | (words[after] != words[at])
    rank[alone] = NO_RANK
    return rank, target


def _from_left(at: np.ndarray, words: np.ndarray, safe: np.ndarray) -> np.ndarray:
    """Of the places with a word's least rank: the first, or all that do not overlap if safe."""
    opens = np.concatenate(([True], words[1:] != words[:-1]))
    runs = np.concatenate(([True], (at[1:] != at[:-1] + 1) | opens[1:]))
    run_start = np.maximum.accumulate(np.where(runs, np.arange(len(at)), 0))
    every_other = (np.arange(len(at)) - run_start) % 2 == 0
    return at[opens | (every_other & safe)]


class Encoder:
    """Encodes texts in one task, with a table of words whose ids are known."""

    def __init__(self, model: Model) -> None:
        self.model = model
        # A line feed that is in no piece separates words as well.
        self.split = re.compile(
            f"{SPACE}*[^{SPACE}]+|{SPACE}+" if "\n" in model.symbols
            else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        model = self.model
        number = model.symbols.get
        text = "".join(words)
        symbols = np.fromiter((number(c, -1) for c in text), np.int32, len(text))
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbols, owner, place = merge_rounds(model, symbols, owner)
        # Whatever is no piece now is a single character, and becomes its bytes.
        unknown = np.flatnonzero((symbols < 0) | (symbols >= len(model.pieces)))
        spelled = [text[p].encode() for p in place[unknown].tolist()]
        sizes = np.ones(len(symbols), np.int64)
        sizes[unknown] = [len(b) for b in spelled]
        ids = np.repeat(symbols, sizes)
        firsts = (np.cumsum(sizes) - sizes)[unknown]
        ids[ranges(firsts, sizes[unknown])] = model.byte_ids[
            np.frombuffer(b"".join(spelled), np.uint8)]
        counts = np.bincount(owner, weights=sizes, minlength=len(words)).astype(np.int64)
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(counts) - counts))
        self.counts = np.concatenate((self.counts, counts))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their number for each text."""
        cut = [self.split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        new = list({w for words in cut for w in words if w not in self.known})
        if new:
            self.learn(new)
        sizes = np.array([len(words) for words in cut], np.int64)
        at = np.fromiter((self.known[w] for words in cut for w in words), np.int64, sizes.sum())
        counts = self.counts[at]
        ids = self.ids[ranges(self.starts[at], counts)]
        ends = np.concatenate(([0], np.cumsum(counts)))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.diff(ends[bounds])


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive texts of about ``CHUNK_CHARS`` characters, with the place of the first."""
    first, held, size = 0, [], 0
    for text in texts:
        value = text.as_py()
        held.append(value)
        size += len(value or "")
        if size >= CHUNK_CHARS:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def encode(documents: DataFrame, model: Model, *, text_col: str = "text",
           ids_col: str = "ids") -> DataFrame:
    """All columns of ``documents`` with the ids of the text; that column is replaced."""
    before = documents.drop(ids_col)
    names = before.columns
    at = names.index(text_col)
    schema = T.StructType([*before.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            for first, texts in _chunks(batch.column(at)):
                ids, counts = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, len(texts)).columns, lists(ids, counts)],
                    names=[*names, ids_col])

    return before.mapInArrow(lean(encoded), schema)


def piece_bytes(model: Model) -> list[bytes]:
    """What each id decodes to."""
    return [
        bytes([int(piece[3:5], 16)]) if kind == 1 else b"" if kind == 2
        else " ⁇ ".encode() if kind == 3 else piece.replace(SPACE, " ").encode()
        for piece, kind in zip(model.pieces, model.kinds.tolist())
    ]


def decode(encoded: DataFrame, model: Model, *, ids_col: str = "ids",
           text_col: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` with the text of the ids; that column is replaced.

    The space put before the text is taken off again. Bytes that are not UTF-8, which
    no text encodes to, become U+FFFD.
    """
    before = encoded.drop(text_col)
    names = before.columns
    at = names.index(ids_col)
    schema = T.StructType([*before.schema.fields, T.StructField(text_col, T.StringType())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_bytes(model)
        control = np.flatnonzero(model.kinds == 2).tolist()
        for batch in batches:
            texts = []
            for ids in batch.column(at):
                values = ids.values.to_numpy().tolist() if ids.is_valid else []
                raw = b"".join(map(table.__getitem__, values))
                shown = next((i for i in values if i not in control), None)
                if shown is not None and model.pieces[shown].startswith(SPACE):
                    raw = raw[1:]
                texts.append(raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*names, text_col])

    return before.mapInArrow(lean(decoded), schema)
