"""Periodic runs of words, from a dictionary of basic factors.

A run is a stretch of consecutive words whose smallest period is q (words q apart are equal),
of at least ``max(min_words, 2 * q)`` words, that no neighbouring word extends with period q.

The basic factors are the stretches of 2**k words. The dictionary gives two of them in one
text the same name exactly if they are equal: names of length 2m are pairs of names of length
m. A factor that stands once in its text has no name, nor has any that contains it, so the
dictionary thins out fast over prose. For every length m, the occurrences of a factor are
chained while successors are at most m / 2 apart; by the periodicity lemma such a chain
is an arithmetic progression with the factor's own period. Periods of up to 2m are proposed by

* the step inside a progression,
* the distance of an occurrence to the first of a later progression of the same factor,
* the distance of the last of a progression to the last of a later one.

Later progressions start more than m / 2 words on each, so at most three lie within 2m words.
These proposals meet every run: let m be at least q / 2 and s its first word. The factor at s
stands again at s + q, in the same progression only if q is its step. Otherwise, if the
first progression starts before s, the second starts at s + q (the run would reach
further left if not); else the progressions end q apart or, if the run ends first, its first q
words repeat nothing shorter and the second starts at s + q as well.

Proposals that go on from the word before are one run and kept once. Each is extended to both
sides by the dictionary, longest factors first, and of equal stretches the smallest
period stays. All steps are array operations over the texts of a chunk.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has no words, no runs
and collapses to an empty text; repeated rows get the same result; null ids are values like any
other; other columns stay as they are, and a column that clashes with a new one is replaced. A
text of any length is taken whole, in memory in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewharf.llm.common import lean, let, raw_bytes

MIN_WORDS = 12
#: Words of texts that are worked on together; a longer text is a chunk of its own.
CHUNK_WORDS = 1 << 18

RUN = T.StructType([
    T.StructField("start", T.LongType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("period", T.LongType(), False),
])


def runs(
    documents: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS,
) -> DataFrame:
    """Add ``n_words``, ``runs`` (by start, then period) and ``collapsed``.

    ``collapsed`` is the text's words joined by one space, without those that any run
    holds after its first period.
    """
    new = ("n_words", "runs", "collapsed")
    kept = documents.select(
        F.col(text_col).alias("__text"),
        F.struct(*[c for c in documents.columns if c not in new]).alias("__row"))
    schema = T.StructType([
        kept.schema["__row"],
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN, False)),
        T.StructField("collapsed", T.StringType()),
    ])

    @lean
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _chunks(batch.column(0)):
                n_words, found, collapsed = find(texts, min_words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, len(texts)), n_words, found, collapsed],
                    names=schema.names)

    return kept.mapInArrow(task, schema).select("__row.*", *new)


def echoed(text: Column, doc_id: Column) -> Column:
    """The text, for one id in ten with its words from some point on replaced by an echo.

    With h the CRC-32 of the id in decimal and g = h // 10: if h is a multiple of ten, every
    word i >= a becomes word a + (i - a) % p, with a = g % n and p = 1 + (n - a) // (3 + g % 8).
    Other texts, those without words and those of null ids stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def echo(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        return let(F.struct(a.cast("int").alias("a"), p.cast("int").alias("p")), lambda to: F.array_join(
            F.transform(words, lambda w, i: F.when(i < to["a"], w).otherwise(
                F.get(words, to["a"] + F.pmod(i - to["a"], to["p"])))), " "))

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    return F.when(h % 10 == 0, let(words, lambda own: F.when(
        F.size(own) > 0, echo(own)).otherwise(text))).otherwise(text)


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The words of the rows in order, in chunks: number of the first row and its rows."""
    first, held, rows = 0, 0, []
    for i, text in enumerate(raw_bytes(column)):
        words = text.split() if text else []
        if rows and held + len(words) > CHUNK_WORDS:
            yield first, rows
            first, held, rows = i, 0, []
        rows.append(words)
        held += len(words)
    if rows:
        yield first, rows


def find(
    texts: list[list[bytes]], min_words: int = MIN_WORDS,
) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Number of words, runs and collapsed text of each text, given by its words."""
    counts = np.array([len(words) for words in texts], np.int64)
    # A separator that equals nothing follows every text.
    begins = np.concatenate(([0], np.cumsum(counts + 1)))
    table: dict[bytes, int] = {}
    number = np.full(begins[-1], -1, np.int64)
    for words, at in zip(texts, begins):
        number[at:at + len(words)] = [table.setdefault(w, len(table)) for w in words]
    row = np.repeat(np.arange(len(texts)), counts + 1)
    starts, lengths, periods = _runs(number, row, len(table), min_words)

    owner = row[starts]
    dropped = np.zeros(len(number) + 1, np.int64)
    np.add.at(dropped, starts + periods, 1)
    np.add.at(dropped, starts + lengths, -1)
    stays = np.cumsum(dropped)[:-1] == 0
    touched = np.zeros(len(texts), bool)
    touched[owner] = True
    collapsed = [
        b" ".join(words) if not touched[i] else
        b" ".join([w for w, keep in zip(words, stays[begins[i]:begins[i] + len(words)]) if keep])
        for i, words in enumerate(texts)
    ]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
    values = pa.StructArray.from_arrays(
        [pa.array(starts - begins[owner]), pa.array(lengths), pa.array(periods)],
        fields=[pa.field(f.name, pa.int64(), False) for f in RUN.fields])
    found = pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), values, type=pa.list_(pa.field("element", values.type, False)))
    return pa.array(counts), found, pa.array(collapsed, pa.binary()).cast(pa.string())


def _runs(
    number: np.ndarray, row: np.ndarray, n_words: int, min_words: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs of all texts, by start and period."""
    names, proposals = [], []
    level = _named(np.flatnonzero(number >= 0), (row * n_words + number)[number >= 0], len(number))
    while True:
        names.append(level)
        length = 1 << (len(names) - 1)
        if 3 * length >= min_words or length >= 4:  # shorter factors meet no other run
            proposals.append(_proposed(level, length))
        ahead = np.full(len(level), -1, level.dtype)
        ahead[:-length or None] = level[length:]
        at = np.flatnonzero((level >= 0) & (ahead >= 0))
        if not len(at) or 2 * length >= len(number):
            break
        level = _named(at, level[at].astype(np.int64) * len(level) + ahead[at], len(number))
        if (level < 0).all():
            break
    at, period = (np.concatenate(x) for x in zip(*proposals)) if proposals else (
        np.zeros(0, np.int64), np.zeros(0, np.int64))
    # Proposals of a period at neighbouring words belong to one run.
    code = np.unique(period * len(number) + at)
    code = code[np.diff(code, prepend=-2) != 1]
    period, at = code // len(number), code % len(number)
    start, end = at.copy(), at.copy()
    for k in range(len(names) - 1, -1, -1):
        start = _back(names[k], start, period, 1 << k)
        end = _ahead(names[k], end, period, 1 << k)
    length = end - start + period
    good = length >= np.maximum(min_words, 2 * period)
    start, length, period = start[good], length[good], period[good]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = (np.diff(start, prepend=-1) != 0) | (np.diff(length, prepend=-1) != 0)
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _named(at: np.ndarray, code: np.ndarray, size: int) -> np.ndarray:
    """Equal numbers for positions with equal codes, -1 where a code stands once or not at all."""
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    level = np.full(size, -1, np.int32)
    again = counts[inverse] > 1
    level[at[again]] = inverse[again]
    return level


def _proposed(level: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods of up to 2m that occurrences of factors of m words propose."""
    at = np.flatnonzero(level >= 0)
    at = at[np.argsort(level[at], kind="stable")]
    name = level[at]
    gap = np.diff(at, append=0)
    same = np.append(name[1:] == name[:-1], False) if len(at) else np.zeros(0, bool)
    chained = same & (2 * gap <= m)
    places, periods = [at[chained]], [gap[chained]]
    is_last = ~chained
    group = np.concatenate(([0], np.cumsum(is_last)[:-1])) if len(at) else at
    last = at[is_last]
    first = at[np.concatenate(([True], is_last[:-1]))] if len(at) else at
    name_of = name[is_last]
    for step in (1, 2, 3):
        def later(own: np.ndarray, groups: np.ndarray, of: np.ndarray) -> None:
            inside = groups + step < len(of)
            own, groups = own[inside], groups[inside]
            distance = of[groups + step] - own
            good = (name_of[groups] == name_of[groups + step]) & (distance <= 2 * m)
            places.append(own[good])
            periods.append(distance[good])

        later(at, group, first)
        later(last, np.arange(len(last)), last)
    return np.concatenate(places), np.concatenate(periods)


def _ahead(level: np.ndarray, end: np.ndarray, period: np.ndarray, m: int) -> np.ndarray:
    """Ends moved on by m where the m words from there equal those one period on."""
    inside = end + period < len(level)
    own = np.where(inside, level[np.where(inside, end, 0)], -1)
    other = np.where(inside, level[np.where(inside, end + period, 0)], -1)
    return np.where((own >= 0) & (own == other), end + m, end)


def _back(level: np.ndarray, start: np.ndarray, period: np.ndarray, m: int) -> np.ndarray:
    """Starts moved back by m where the m words before equal those one period on."""
    before = start - m
    own = np.where(before >= 0, level[np.maximum(before, 0)], -1)
    other = level[np.maximum(before, 0) + period]
    return np.where((own >= 0) & (own == other), before, start)


#: The registered query over echoed documents; CRC-32 bit by bit, runs as islands of equal stretches of four words.
ORACLE_SQL = r"""
with hashed as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint),
           lambda c, byte: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::bigint[],
             lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(c, byte)),
           4294967295::bigint), 4294967295::bigint) as h
  from documents),
planned as (
  select *, h // 10 as g, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from hashed),
echoed as materialized (
  select row_number() over () as row, doc_id, case when a is null then w else list_transform(range(len(w)),
         lambda i: case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end) end as w
  from (select *, 1 + (len(w) - a) // (3 + g % 8) as p from planned)),
fours as materialized (
  select row, pos, len(w) as n, array_to_string(w[pos + 1:pos + 4], ' ') as four
  from (select row, w, unnest(range(len(w) - 3)) as pos from echoed)),
again as (
  select x.row, x.pos, y.pos - x.pos as q from fours x join fours y
  on x.row = y.row and x.four = y.four and y.pos > x.pos and 2 * (y.pos - x.pos) <= x.n),
islands as (
  select row, q, pos, pos - row_number() over (partition by row, q order by pos) as island from again),
stretches as (
  select row, q, min(pos) as start, count(*) + 3 + q as length from islands group by row, q, island),
runs as materialized (
  select row, start, length, min(q) as period from stretches where length >= greatest(12, 2 * q)
  group by row, start, length),
summed as (
  select row, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), ''
           order by start, period) as listed,
         list({'start': start, 'length': length, 'period': period} order by length desc, start, period)[1] as top
  from runs group by row),
places as (
  select distinct row, unnest(range(start + period, start + length)) as pos from runs),
kept as (
  select e.row, array_to_string(list(e.word order by e.pos), ' ') as collapsed
  from (select row, unnest(w) as word, unnest(range(len(w))) as pos from echoed) e
  anti join places p on e.row = p.row and e.pos = p.pos group by e.row)
select e.doc_id, coalesce(n_runs, 0) as n_runs, top.start::bigint as start, top.length::bigint as length,
       top.period::bigint as period, (1000 * top.length // top.period)::bigint as exponent_milli,
       sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(collapsed, '')) as collapsed_sha256,
       len(w)::bigint as n_words
from echoed e left join summed using (row) left join kept using (row)
"""
