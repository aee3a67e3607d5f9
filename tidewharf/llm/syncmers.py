"""Document fingerprints of closed syncmers.

A k-mer of characters is chosen if the least of its inner s-mers (by hash) is the first or
the last of them. Whether it is chosen depends on the k-mer alone, so an edit changes only
the anchors that overlap it, and at least one of every ``WINDOW`` consecutive k-mers is an
anchor unless s-mers repeat. Anchors keep their position for positional matching.

Defined results: a null text counts as empty; a text without a chosen k-mer (a short one) has
one anchor at position 0 that stands for the whole text; equal texts have equal fingerprints;
the likeness of two fingerprints is the share of their anchors that match in order: the
longest run of matches whose positions rise in both texts, twice over the number of anchors of
both. A hash that repeats is matched first with first, second with second, and so on.

A fingerprint holds a tenth of the anchors, so an edit between those does not show in it. What
compares whole texts does so by all anchors beside it: a digest of them and their likeness.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewharf.llm.common import lean, let

#: Length of s-mers, and s-mers in a k-mer (a power of two); k is INNER + WINDOW - 1.
INNER = 8
WINDOW = 16
CHUNK_CHARS = 1 << 19
#: One anchor in so many is kept in a fingerprint, and so many at least.
KEPT_OF = 10
LEAST_KEPT = 4

_FACTOR = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of all anchors, text after text, and their numbers."""
    lengths = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n, k = len(chars), INNER + WINDOW - 1
    owner = np.repeat(np.arange(len(texts)), lengths)
    begins = np.cumsum(lengths) - lengths
    if n >= k:
        # Polynomial hashes of 1, 2, 4 ... characters; each pass doubles the length.
        h = _mix(chars.astype(np.uint64) + np.uint64(1))
        power, size = _FACTOR, 1
        inner = None
        while size < WINDOW:
            if size == INNER:
                inner = h
            h = h[:-size] * np.uint64(power) + h[size:]
            power, size = power * power & _MASK, size * 2
        least = _mix(inner)
        edge = least
        step = 1
        while step < WINDOW:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        places = n - k + 1
        chosen = (edge[:places] == least) | (edge[WINDOW - 1:] == least)
        chosen &= owner[:places] == owner[k - 1:]
        at = np.flatnonzero(chosen)
        hashes = _mix(h[at] * np.uint64(_FACTOR) + inner[at + WINDOW - 1])
    else:
        at, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    counts = np.bincount(owner[at], minlength=len(texts)).astype(np.int64)
    bare = np.flatnonzero(counts == 0)
    whole = [int.from_bytes(hashlib.sha256(texts[i].encode("utf-8", "surrogatepass")).digest()[:8])
             for i in bare.tolist()]
    before = np.cumsum(counts) - counts
    positions = np.insert(at - begins[owner[at]], before[bare], 0)
    hashes = np.insert(hashes, before[bare], np.array(whole, np.uint64))
    counts[bare] = 1
    return positions.astype(np.int32), (hashes >> np.uint64(32)).astype(np.uint32), counts


def _grouped(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, held, size = 0, [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHUNK_CHARS:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def all_anchors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and hashes of each text's anchors, in order of position."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for _, group in _grouped(texts):
        positions, hashes, counts = anchors(group)
        for end, n in zip(np.cumsum(counts).tolist(), counts.tolist()):
            # Copies, as a slice would hold the whole group in memory.
            out.append((positions[end - n:end].copy(), hashes[end - n:end].copy()))
    return out


def _kept(positions: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(hashes % np.uint32(KEPT_OF) == 0)
    if len(at) < LEAST_KEPT:
        at = np.sort(np.argsort(hashes, kind="stable")[:LEAST_KEPT])
    return positions[at], hashes[at]


def kept_anchors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and hashes of the anchors in each text's fingerprint, in order of position."""
    return [_kept(*own) for own in all_anchors(texts)]


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """The share of two sequences of hashes that matches in order."""
    def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes with the number of their occurrence as one code, sorted, and their places."""
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order].astype(np.uint64)
        starts = np.flatnonzero(np.diff(ranked, prepend=ranked[:1] + np.uint64(1)))
        nth = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.append(starts, len(ranked))))
        return ranked << np.uint64(32) | nth.astype(np.uint64), order

    (a, places), (b, others) = numbered(one), numbered(other)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    matched = others[j][np.argsort(places[i])].tolist()
    tails: list[int] = []
    for place in matched:
        at = bisect_left(tails, place)
        tails[at:at + 1] = [place]
    return 2 * len(tails) / (len(one) + len(other))


def fingerprint(documents: DataFrame, *, text_col: str = "text",
                anchors_col: str = "anchors") -> DataFrame:
    """All columns of ``documents`` with the anchors (position, hash); that column is replaced."""
    before = documents.drop(anchors_col)
    names = before.columns
    at = names.index(text_col)
    schema = T.StructType([*before.schema.fields, T.StructField(
        anchors_col, T._parse_datatype_string("array<struct<pos:int,hash:bigint>>"))])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for first, group in _grouped(texts):
                positions, hashes, counts = anchors(group)
                values = pa.StructArray.from_arrays(
                    [pa.array(positions), pa.array(hashes.astype(np.int64))], ["pos", "hash"])
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(first, len(group)).columns,
                     pa.ListArray.from_arrays(pa.array(offsets), values)],
                    names=[*names, anchors_col])

    return before.mapInArrow(lean(found), schema)


def in_order(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``bucket, extra, id, text`` in consecutive ranges of ids, each sorted within a task.

    At the end of each range, marked ``extra``, is a copy of the row that follows it; after
    the last range that is the first row. Ids that are null come last, equal ids in order
    of the text. The ranges begin at ids that Spark's range partitioning has found; one
    number for each partition is all that goes to the driver.
    """
    spark = documents.sparkSession
    source = documents.select(F.col(id_col).cast("bigint").alias("id"),
                              F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    begins = sorted(
        r["first"] for r in source.select("id").where("id is not null")
        .repartitionByRange(n, "id").withColumn("p", F.spark_partition_id())
        .groupBy("p").agg(F.min("id").alias("first")).collect())
    ranges = max(1, len(begins))

    def range_code(firsts: Column) -> Column:
        """Twice the number of the id's range, plus one for the first id of it; by halving."""
        steps = F.lit([1 << i for i in reversed(range(ranges.bit_length()))])
        at = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            F.get(firsts, at + step) <= F.col("id"), at + step).otherwise(at))
        return let(at, lambda at: 2 * at + (F.get(firsts, at) == F.col("id")).cast("int"))

    code = F.lit(2 * (ranges - 1))
    if begins:
        firsts = F.lit(begins).cast("array<bigint>")
        code = F.when(F.col("id").isNull(), code).otherwise(range_code(firsts))

    def place(bucket: Column, extra: bool) -> Column:
        return F.struct(bucket.cast("int").alias("bucket"), F.lit(extra).alias("extra"))

    own = F.shiftright("code", 1)
    placed = source.withColumn("code", code.cast("bigint")).withColumn("place", F.explode(
        F.when((F.col("code") % 2 == 1) & F.col("id").isNotNull(), F.array(
            place(own, False), place(F.pmod(own - 1, F.lit(ranges)), True)))
        .otherwise(F.array(place(own, False)))))
    return (
        placed.select("place.*", "id", "text")
        .repartitionById(max(n, ranges), F.col("bucket"))
        .sortWithinPartitions("bucket", "extra", F.col("id").asc_nulls_last(), "text")
    )


def compare_with_next(documents: DataFrame, *, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited one, and their likeness.

    The edited text has its last quarter of code points replaced by the first as many of
    the next document in order of the id. ``near_edited`` and ``near_next`` compare fingerprints;
    ``n_anchors``, ``anchors_sha256``, ``near_edited_all`` and the like are of all anchors.
    """
    schema = ("id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
              "edited_fingerprint string, near_edited double, near_next double, n_anchors bigint, "
              "anchors_sha256 string, edited_anchors_sha256 string, near_edited_all double, "
              "near_next_all double")

    def compared(ids: list, texts: list[str], own: list) -> pa.RecordBatch:
        """Rows for all but the last text."""
        edited = []
        for text, after in zip(texts, texts[1:]):
            cut = len(text) // 4
            edited.append(text[:len(text) - cut] + after[:cut])
        others = all_anchors(edited)
        kept, kept_others = [_kept(*a) for a in own], [_kept(*a) for a in others]

        def near(some: list, more: list) -> pa.Array:
            return pa.array((likeness(a, b) for (_, a), (_, b) in zip(some, more)), pa.float64())

        return pa.RecordBatch.from_pydict({
            "id": pa.array(ids, pa.int64()),
            "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": [_shown(*a) for a in kept[:-1]],
            "edited_fingerprint": [_shown(*a) for a in kept_others],
            "near_edited": near(kept, kept_others),
            "near_next": near(kept, kept[1:]),
            "n_anchors": pa.array([len(p) for p, _ in own[:-1]], pa.int64()),
            "anchors_sha256": [_digest(*a) for a in own[:-1]],
            "edited_anchors_sha256": [_digest(*a) for a in others],
            "near_edited_all": near(own, others),
            "near_next_all": near(own, own[1:]),
        })

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, ids, texts, known, first, closed = None, [], [], [], "", False

        def flush(after: str | None) -> pa.RecordBatch:
            """All texts held, with the text that comes after them; or all but the last."""
            nonlocal ids, texts, known
            every = texts if after is None else [*texts, after]
            own = known + all_anchors(every[len(known):])
            out = compared(ids[:len(every) - 1], every, own)
            ids, texts, known = ids[-1:], texts[-1:], own[-1:] if after is None else []
            return out

        size = 0
        for batch in batches:
            for b, extra, doc_id, text in zip(*(batch[c].to_pylist() for c in batch.schema.names)):
                if b != bucket:
                    if texts and not closed:
                        yield flush(first)
                    bucket, ids, texts, known, first, closed = b, [], [], [], text, False
                    size = 0
                if extra:
                    if not closed:
                        yield flush(text)
                    closed = True
                    continue
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= CHUNK_CHARS and len(texts) > 1:
                    yield flush(None)
                    size = 0
        if texts and not closed:
            yield flush(first)

    return in_order(documents, id_col, text_col).mapInArrow(lean(walked), schema)


def _shown(positions: np.ndarray, hashes: np.ndarray) -> str:
    """Each anchor's distance from the one before, seven bits a byte, and its hash, in base 64."""
    out = bytearray()
    for distance, hashed in zip(np.diff(positions, prepend=0).tolist(), hashes.tolist()):
        while distance > 127:
            out.append(distance & 127 | 128)
            distance >>= 7
        out.append(distance)
        out += hashed.to_bytes(4, "big")
    return base64.b64encode(out).decode()


def _digest(positions: np.ndarray, hashes: np.ndarray) -> str:
    """Of all positions and then all hashes, four bytes each, the lowest first."""
    return hashlib.sha256(positions.astype("<i4").tobytes() + hashes.astype("<u4").tobytes()).hexdigest()
