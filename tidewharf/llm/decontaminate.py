"""Benchmark decontamination with a positional inverted index.

The index is cut by document: a row is a block of documents with the postings of
every token in them, terms in order of their hash and positions as gaps. Building it
is one pass without a shuffle, and so is searching: a task reads a block, looks up
the terms asked for and intersects their lists, each shifted by the term's offset in
the phrase, from the term that is rarest in the whole corpus. Test phrases go to the
tasks in chunks of at most ``CHUNK`` windows, so a large test set is several passes.

Words: ``A-Z`` in lower case, then runs of ASCII letters, digits and characters beyond
ASCII. A test item is all its windows of ``window`` consecutive words, or one window of
the whole item if it has fewer.

Defined results: null and empty texts have no words and no hits; an item without words
never occurs; a null item id is listed as "null"; items and documents may repeat, every
document row gets its own result row; terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewharf.llm.common import LARGE_ROWS, lean, list_values, one_list, ranges, raw_bytes, saved

WINDOW = 10
#: Words to either side of the rarest word within which a proximity match must lie.
NEAR = 20
BLOCK_WORDS = 1 << 19
CHUNK = 250_000

_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def term_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


class _Block:
    """Documents gathered until they make a block."""

    def __init__(self) -> None:
        self.ids: list = []
        self.sizes: list[int] = []
        self.terms: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []
        self.n_words = 0

    def add(self, doc_id, words: list[bytes]) -> None:
        terms = self.terms
        number = terms.setdefault
        self.tokens.append(np.array([number(w, len(terms)) for w in words], np.int32))
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.n_words += len(words)

    def row(self, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        hashes = term_hashes(list(self.terms))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        tokens = rank[np.concatenate(self.tokens)] if self.n_words else np.zeros(0, np.int32)
        positions = np.argsort(tokens, kind="stable").astype(np.int32)
        counts = np.bincount(tokens, minlength=len(order)).astype(np.int32)
        firsts = np.cumsum(counts) - counts
        gaps = np.diff(positions, prepend=np.int32(0))
        gaps[firsts] = positions[firsts]
        return pa.RecordBatch.from_pydict({
            "block": pa.array([number], pa.int64()),
            "doc_ids": one_list(pa.array(self.ids, id_type)),
            "sizes": one_list(np.array(self.sizes, np.int32)),
            "terms": one_list(hashes[order]),
            "counts": one_list(counts),
            "gaps": one_list(gaps.astype(np.int32)),
        })


def build_index(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                block_words: int = BLOCK_WORDS) -> DataFrame:
    """Store the postings of every token of every document; one row per block."""
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        block, id_type = _Block(), None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for doc_id, text in zip(batch["id"].to_pylist(), raw_bytes(batch["text"])):
                words = words_of(text)
                if block.ids and block.n_words + len(words) > block_words:
                    yield block.row(number, id_type)
                    block, number = _Block(), number + 1
                block.add(doc_id, words)
        if block.ids:
            yield block.row(number, id_type)

    kind = source.schema["id"].dataType.simpleString()
    schema = (f"block bigint, doc_ids array<{kind}>, sizes array<int>, terms array<bigint>, "
              "counts array<int>, gaps array<int>")
    return saved(source.mapInArrow(lean(build), schema), "postings", LARGE_ROWS)


def windows(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text",
            window: int = WINDOW) -> DataFrame:
    """All windows of the test items: item (text), terms (hashes in order)."""
    source = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"),
                          F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item"].to_pylist(), raw_bytes(batch["text"])):
                terms = term_hashes(words_of(text)).tolist()
                if terms:
                    found = [terms[i:i + window] for i in range(max(1, len(terms) - window + 1))]
                    yield pa.RecordBatch.from_pydict({
                        "item": pa.array([item] * len(found), pa.string()),
                        "terms": pa.array(found, pa.list_(pa.int64())),
                    })

    return source.mapInArrow(lean(cut), "item string, terms array<bigint>").distinct()


class _Plan:
    """Windows with their terms from the rarest on; bounded by the chunk."""

    def __init__(self, rows: pa.Table, frequency: dict[int, int]) -> None:
        found = rows.to_pylist()
        self.items = sorted({r["item"] for r in found})
        numbers = {item: i for i, item in enumerate(self.items)}
        longest = max(len(r["terms"]) for r in found)
        self.terms = np.array(sorted(frequency), np.int64)
        places = {term: i for i, term in enumerate(self.terms.tolist())}
        usable = [r for r in found if all(t in places for t in r["terms"])]
        self.item = np.array([numbers[r["item"]] for r in usable], np.int32)
        self.length = np.array([len(r["terms"]) for r in usable], np.int32)
        self.term = np.full((len(usable), longest), -1, np.int64)
        self.offset = np.zeros((len(usable), longest), np.int64)
        for i, r in enumerate(usable):
            rarest = sorted(range(len(r["terms"])), key=lambda k: (frequency[r["terms"][k]], k))
            self.term[i, :len(rarest)] = [places[r["terms"][k]] for k in rarest]
            self.offset[i, :len(rarest)] = rarest


def _matches(plan: _Plan, terms, counts, gaps, begins, near: int):
    """(document, window, start) of phrase matches, and (document, window) of proximity ones."""
    at = np.searchsorted(terms, plan.terms)
    at[at == len(terms)] = 0
    present = terms[at] == plan.terms if len(terms) else np.zeros(len(plan.terms), bool)
    all_there = np.where(plan.term >= 0, present[plan.term], True).all(axis=1)
    usable = np.flatnonzero(all_there)
    nothing = np.zeros(0, np.int64)
    if not len(usable):
        return (nothing, nothing, nothing), (nothing, nothing)
    # One sorted array of all postings asked for: term in the upper half, position below.
    wanted = np.flatnonzero(present)
    sizes = counts[at[wanted]].astype(np.int64)
    firsts = (np.cumsum(counts, dtype=np.int64) - counts)[at[wanted]]
    absolute = np.cumsum(gaps[ranges(firsts, sizes)], dtype=np.int64)
    own = np.cumsum(sizes) - sizes
    base = np.where(own > 0, absolute[own - 1], 0)
    positions = absolute - np.repeat(base, sizes)
    keys = (np.repeat(wanted, sizes) << 32) | positions
    first_of, size_of = np.zeros(len(plan.terms), np.int64), np.zeros(len(plan.terms), np.int64)
    first_of[wanted], size_of[wanted] = own, sizes

    rarest = plan.term[usable, 0]
    window = np.repeat(usable, size_of[rarest])
    anchor = positions[ranges(first_of[rarest], size_of[rarest])]
    document = np.searchsorted(begins, anchor, side="right") - 1

    exact, start = np.arange(len(window)), anchor - plan.offset[window, 0]
    inside = (start >= begins[document]) & (
        start + plan.length[window] <= begins[document + 1])
    exact, start = exact[inside], start[inside]
    low, high = np.maximum(anchor - near, begins[document]), np.minimum(
        anchor + near, begins[document + 1] - 1)
    close = np.arange(len(window))
    for k in range(1, plan.term.shape[1]):
        w = window[exact]
        asked = plan.term[w, k]
        key = (asked << 32) | (start + plan.offset[w, k])
        found = (asked < 0) | (keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key)
        exact, start = exact[found], start[found]
        asked = plan.term[window[close], k]
        i = np.minimum(np.searchsorted(keys, (asked << 32) | low[close]), len(keys) - 1)
        key = keys[i]
        found = (asked < 0) | (
            (key >= ((asked << 32) | low[close])) & (key <= ((asked << 32) | high[close])))
        close = close[found]
    return ((document[exact], window[exact], start - begins[document[exact]]),
            (document[close], window[close]))


def _spans(plan: _Plan, document, window, start):
    """Phrase matches of an item in a document joined where they touch or overlap."""
    item, length = plan.item[window], plan.length[window]
    order = np.lexsort((start, item, document))
    document, item, start, length = (x[order] for x in (document, item, start, length))
    new = np.ones(len(order), bool)
    new[1:] = (document[1:] != document[:-1]) | (item[1:] != item[:-1]) | (
        start[1:] > start[:-1] + length[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(order)])) - 1 if len(order) else first
    return document[first], item[first], start[first], start[last] + length[last]


def search(index: DataFrame, test_windows: DataFrame, *, near: int = NEAR,
           chunk: int = CHUNK) -> DataFrame:
    """Matches of the windows: block, place (document in the block), item, begin and end.

    ``begin`` and ``end`` count words of the document; matches of an item that touch are one
    row if they were searched for in the same chunk. A row without them is a proximity
    match: all words of a window, in any order, within ``near`` words of its rarest one.
    """
    spark = index.sparkSession
    test_windows = saved(test_windows, "windows")
    chunks = -(-test_windows.count() // chunk)
    part = F.pmod(F.xxhash64("item", "terms"), F.lit(max(1, chunks)))
    schema = "block bigint, place int, item string, begin int, end int"
    found = [
        _search_chunk(index, test_windows.where(part == i).toArrow(), near, schema)
        for i in range(chunks)
    ]
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)


def _search_chunk(index: DataFrame, rows: pa.Table, near: int, schema: str) -> DataFrame:
    terms = np.unique(rows["terms"].combine_chunks().flatten().to_numpy(zero_copy_only=False))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(terms), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                own, counts = list_values(batch["terms"], i), list_values(batch["counts"], i)
                if len(own):
                    at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                    totals += np.where(own[at] == terms, counts[at], 0)
        there = totals > 0
        yield pa.RecordBatch.from_pydict({"term": terms[there], "n": totals[there]})

    frequency = {
        r["term"]: r["n"]
        for r in index.select("terms", "counts").mapInArrow(lean(counted), "term bigint, n bigint")
        .groupBy("term").agg(F.sum("n").alias("n")).collect()
    }
    plan = _Plan(rows, frequency)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch["block"][i].as_py()
                own, counts, gaps, sizes = (
                    list_values(batch[c], i) for c in ("terms", "counts", "gaps", "sizes"))
                begins = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
                # Empty documents share a begin with the next; searches find the last of them.
                exact, close = _matches(plan, own, counts, gaps, begins, near)
                place, item, begin, end = _spans(plan, *exact)
                other = np.unique(np.stack((close[0], plan.item[close[1]])), axis=1)
                there = len(place)
                place = np.concatenate((place, other[0]))
                item = np.concatenate((item, other[1]))
                empty = pa.nulls(len(place) - there, pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(np.full(len(place), block, np.int64)),
                    "place": pa.array(place.astype(np.int32)),
                    "item": pa.array([plan.items[j] for j in item.tolist()], pa.string()),
                    "begin": pa.concat_arrays([pa.array(begin.astype(np.int32)), empty]),
                    "end": pa.concat_arrays([pa.array(end.astype(np.int32)), empty]),
                })

    if not len(plan.item):
        return index.sparkSession.createDataFrame([], schema)
    return index.select("block", "sizes", "terms", "counts", "gaps").mapInArrow(lean(searched), schema)


def contamination(documents: DataFrame, items: DataFrame, *, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, near: int = NEAR) -> DataFrame:
    """One row per document: words, words hit, spans, and the items found in it.

    ``items`` are in order of their ids as text; ``near_items`` also has those found by
    proximity only.
    """
    index = build_index(documents, id_col=id_col, text_col=text_col)
    matches = search(index, windows(items, id_col=item_id_col, text_col=item_text_col,
                                    window=window), near=near)
    phrase = F.col("begin").isNotNull()
    hits = matches.groupBy("block", "place").agg(
        F.array_sort(F.collect_set(F.when(phrase, F.col("item")))).alias("items"),
        F.array_sort(F.collect_set("item")).alias("near_items"),
        F.array_sort(F.collect_list(F.when(phrase, F.struct("begin", "end")))).alias("spans"),
    )
    places = index.select(
        "block", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("place", "doc"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reached")),
        lambda done, span: F.struct(
            (done["n"] + F.greatest(F.lit(0), span["end"] - F.greatest(
                span["begin"], done["reached"]))).alias("n"),
            F.greatest(done["reached"], span["end"]).alias("reached"),
        ),
        lambda done: done["n"],
    )
    none = F.array().cast("array<string>")
    return places.join(hits, ["block", "place"], "left").select(
        F.col("doc.doc_ids").alias(id_col),
        F.col("doc.sizes").cast("bigint").alias("n_words"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"),
        "spans",
    )
