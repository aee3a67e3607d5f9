"""Exact n-gram Jaccard join with a matrix of tokens and groups of documents.

A document is its set of hashed word shingles. Two sets with a Jaccard similarity of
at least ``similarity`` share a token among the first few of either in any fixed order
(the prefix), so only prefix tokens are shuffled.

1. In ``ROUNDS`` rounds every document is compared with one partner of about its size: in
   each token bucket the leader is the document with the fewest rare tokens in its prefix,
   and a document takes the leader, of another group than its own, that it shares most of
   its prefix with. The links found make groups of similar documents.
2. The matrix holds each group's union of prefix tokens. A document opens another group
   only if the tokens it shares with the group's union leave room for the similarity and
   one of them comes early enough in both, and is then compared with the group's members.
3. Components of all links are the classes.

The rounds are linear in the documents; they make large groups of near copies one group
before anything is compared group by group. How many there are changes only the cost.

Pairs inside a group are never listed: it is connected already. Tokens that are frequent
come last in the order, so they are in a prefix only where a document has few others;
which tokens count as frequent changes the cost, never the result.

Defined results: a null or empty text has an empty set, links with nothing and keeps its
own id as component; equal texts and repeated rows are one vertex; a component's id is
the least id that is not null. Shingles are compared by 64-bit hashes within a pair;
texts by 128 bits: where two texts share the 64 bits used as vertex, another seed is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewharf.llm.common import delete, discard, lean, raw_bytes, release, saved
from tidewharf.llm.components import components
from tidewharf.session import scratch_dir

SHINGLE = 5
#: A similarity of 4/5 as a fraction: 5 * intersection >= 4 * union.
#: A token is frequent if this many documents of one block hold it, ...
BLOCK_COUNT = 2
BLOCK_TOKENS = 1 << 21
#: ... this many in the sum of such blocks, and one in 2**22 of all tokens or more: at most 2**22 are.
LEAST_FREQUENT = 32
FREQUENT_BITS = 22
#: Rounds with one partner each before groups are opened.
ROUNDS = 2
#: Parts, by token, that prefixes are matched in, so that only one part's rows are shuffled at a time.
PARTS = 4
#: Bits of the filter that keeps texts without a partner out of the comparison's shuffle.
FILTER_BITS = 26

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTORS = np.array([
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
    0xA0761D6478BD642F,
], np.uint64)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    from xxhash import xxh3_64_intdigest

    words = text.translate(_LOWER).split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    if n < size:
        return np.array([xxh3_64_intdigest(b" ".join(words), n)], np.uint64).view(np.int64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    mixed = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        mixed += hashes[i:n - size + 1 + i] * _FACTORS[i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _FACTORS[0]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def _vertex(text: bytes | None, seed: int) -> tuple[int, int]:
    from xxhash import xxh3_128_intdigest

    digest = xxh3_128_intdigest(text or b"", seed)
    return ((digest >> 64) - (1 << 63)), (digest & ((1 << 64) - 1)) - (1 << 63)


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _described(source: DataFrame, seed: int, size: int) -> DataFrame:
    """One row per document (id, carried columns, vertex, check, n) and, with null ``n``,
    rows of tokens that are frequent in a block."""
    carried = [f for f in source.schema.fields if f.name != "text"]
    names = [f.name for f in carried]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        room = BLOCK_TOKENS

        def frequent(fields) -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= BLOCK_COUNT
            n = int(often.sum())
            columns = {name: pa.nulls(n, kind) for name, kind in fields}
            return pa.RecordBatch.from_pydict(columns | {
                "vertex": pa.nulls(n, pa.int64()), "check": pa.nulls(n, pa.int64()),
                "n": pa.nulls(n, pa.int32()), "token": tokens[often],
                "count": counts[often].astype(np.int64),
            })

        fields = []
        for batch in batches:
            fields = [(name, batch.schema.field(name).type) for name in names]
            vertices, checks, sizes = [], [], []
            for text in raw_bytes(batch["text"]):
                tokens = shingles(text, size)
                vertex, check = _vertex(text, seed)
                vertices.append(vertex)
                checks.append(check)
                sizes.append(len(tokens))
                if len(tokens) and vertex not in seen:
                    seen.add(vertex)
                    held.append(tokens)
                    room -= len(tokens)
                    if room <= 0:
                        yield frequent(fields)
                        held, room = [], BLOCK_TOKENS
            yield pa.RecordBatch.from_pydict({name: batch[name] for name in names} | {
                "vertex": pa.array(vertices, pa.int64()), "check": pa.array(checks, pa.int64()),
                "n": pa.array(sizes, pa.int32()),
                "token": pa.nulls(batch.num_rows, pa.int64()),
                "count": pa.nulls(batch.num_rows, pa.int64()),
            })
        if held:
            yield frequent(fields)

    return source.mapInArrow(
        lean(describe), f"{schema}, vertex bigint, check bigint, n int, token bigint, count bigint")


def _prefixes(source: DataFrame, seed: int, size: int, frequent: np.ndarray) -> DataFrame:
    """token, vertex, shape for each token of each prefix; frequent tokens come last in the order.

    The shape holds the size of the set, 16 bits of the token's rank in the prefix (from 0, the
    largest also standing for all beyond) and 8 of how many of its tokens are rare. A vertex with equal texts in several partitions is listed once in each.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tokens, shapes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            vertices, counts = [], []
            for text in raw_bytes(batch["text"]):
                vertex = _vertex(text, seed)[0]
                if vertex in seen:
                    continue
                seen.add(vertex)
                own = shingles(text, size)
                n = rare = len(own)
                if not n:
                    continue
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    last = frequent[at] == own
                    own = np.concatenate((own[~last], own[last]))
                    rare = n - int(last.sum())
                ranks = np.minimum(np.arange(prefix_size(n)), 0xFFFF)
                tokens.append(own[:prefix_size(n)])
                shapes.append(n << 24 | ranks << 8 | min(rare, prefix_size(n), 0xFF))
                vertices.append(vertex)
                counts.append(prefix_size(n))
            yield pa.RecordBatch.from_pydict({
                "token": np.concatenate(tokens),
                "vertex": np.repeat(np.array(vertices, np.int64), counts),
                "shape": np.concatenate(shapes),
            })

    return source.select("text").mapInArrow(lean(cut), "token bigint, vertex bigint, shape bigint")


def _room(shared, n, other):
    """Whether sets of these sizes may be similar, given their shared prefix tokens.

    The tokens of the shorter-reaching prefix that are not shared are in one set only.
    """
    sizes = (n * 5 >= other * 4) & (other * 5 >= n * 4)
    return sizes & (shared * 45 >= (n + other) * 20 - F.greatest(n, other) * 36)


def _verified(
    source: DataFrame, seed: int, size: int, pairs: DataFrame, used: list[DataFrame],
) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Tables that only the result reads go to ``used``."""
    bits = 1 << FILTER_BITS

    def word(vertex: str):
        return F.pmod(F.col(vertex), F.lit(bits)).cast("long")

    ends = pairs.select(word("a").alias("at")).unionAll(pairs.select(word("b").alias("at")))
    # A filter of fixed size (at most 2**20 words): false hits only cost some shuffling.
    words = ends.groupBy(F.shiftright("at", 6).alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("w")).toArrow()
    mask = np.zeros(bits >> 6, np.uint64)
    mask[words["i"].to_numpy()] = words["w"].to_numpy().view(np.uint64)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            vertices, found = [], []
            for text in raw_bytes(batch["text"]):
                vertex = _vertex(text, seed)[0]
                at = vertex % bits
                if vertex in seen or not int(mask[at >> 6]) >> (at & 63) & 1:
                    continue
                seen.add(vertex)
                vertices.append(vertex)
                found.append(shingles(text, size))
                if len(found) == 1000:
                    yield _sets_batch(vertices, found)
                    vertices, found = [], []
            if found:
                yield _sets_batch(vertices, found)

    every = source.select("text").mapInArrow(lean(sets), "vertex bigint, tokens array<bigint>")
    partners = pairs.select(F.col("b").alias("vertex")).distinct()
    firsts = saved(every.join(partners, "vertex", "left_semi").groupBy("vertex").agg(
        F.first("tokens").alias("others")), "partners")
    used.append(firsts)
    one = pairs.join(every.withColumnRenamed("vertex", "a"), "a")
    both = one.join(firsts.withColumnRenamed("vertex", "b"), "b")
    common = F.size(F.array_intersect("tokens", "others"))
    union = F.size("tokens") + F.size("others") - common
    return both.where(common * 5 >= union * 4).select("a", "b").distinct()


def _sets_batch(vertices: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    return pa.RecordBatch.from_pydict({
        "vertex": pa.array(vertices, pa.int64()),
        "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found))),
    })


def similar(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
            carry: tuple[str, ...] = (), size: int = SHINGLE) -> DataFrame:
    """One row per document: ``id``, the carried columns, ``n`` (set size), ``vertex``,
    ``root`` (the same for all of a component, null for empty sets) and ``component`` (its
    least id)."""
    source = documents.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"),
        *[F.col(c).alias(f"carry_{c}") for c in carry])
    seed = 0
    while True:
        described = saved(_described(source, seed, size), "described")
        rows = described.where("n is not null").drop("token", "count")
        clash = rows.groupBy("vertex").agg((F.min("check") < F.max("check")).alias("clash"))
        if clash.where("clash").isEmpty():
            break
        seed += 1
    total = rows.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    least = max(LEAST_FREQUENT, total >> FREQUENT_BITS)
    frequent = np.sort(np.array(
        described.where("token is not null").groupBy("token").agg(F.sum("count").alias("c"))
        .where(F.col("c") >= least).select("token").toArrow()["token"].to_numpy(), np.int64))

    used: list[DataFrame] = []  # tables that the step under way is the last to read

    def done(df: DataFrame, purpose: str) -> DataFrame:
        result = saved(df, purpose)
        for table in used:
            discard(table)
        used.clear()
        release(documents.sparkSession)
        return result

    entries = _shared(_prefixes(source, seed, size, frequent))

    grouped = entries.withColumn("group", F.col("vertex"))
    links = None
    for turn in range(ROUNDS):
        pairs = done(_leaders(grouped, turn, used), "pairs")
        found = _verified(source, seed, size, pairs, used)
        used.append(pairs)
        found = done(found, "links")
        links = found if links is None else links.unionAll(found)
        moved = _regrouped(grouped, found, used)
        used.append(grouped)
        grouped = done(moved, "grouped")
    pairs = _between_groups(grouped, used)
    used.append(grouped)
    pairs = done(pairs, "pairs")
    if not pairs.isEmpty():
        found = _verified(source, seed, size, pairs, used)
        used.append(pairs)
        links = links.unionAll(done(found, "links"))
    groups = components(links)

    rooted = rows.join(groups.withColumnRenamed("v", "vertex"), "vertex", "left").withColumn(
        "root", F.when(F.col("n") > 0, F.coalesce("root", "vertex")))
    rooted = saved(rooted, "rooted")
    ids = saved(rooted.where("root is not null").groupBy("root").agg(F.min("id").alias("least_id")),
                "ids")
    return rooted.join(ids, "root", "left").select(
        "id", *[F.col(f"carry_{c}").alias(c) for c in carry], "n", "vertex", "root",
        F.coalesce("least_id", F.when(F.col("root").isNull(), F.col("id"))).alias("component"))


def _shared(prefixes: DataFrame) -> DataFrame:
    """token, vertex, n, rank, rare of the tokens that documents of near sizes share."""
    spark = prefixes.sparkSession
    path = scratch_dir(spark, "prefixes")
    part = F.col("token").bitwiseAND(F.lit(PARTS - 1)).cast("int")
    prefixes.withColumn("part", part).write.partitionBy("part").option("compression", "zstd").parquet(path)
    every = spark.read.schema("token bigint, vertex bigint, shape bigint, part int").parquet(path)
    entries = None
    for number in range(PARTS):
        rows = every.where(F.col("part") == number).drop("part")
        # Of two documents that share a token, neither matters if their sizes are too far apart.
        shared = rows.groupBy("token").agg(
            F.min("vertex").alias("least"), F.max("vertex").alias("last"), F.count("*").alias("c"),
            F.min("shape").alias("small"), F.max("shape").alias("large"),
        ).where("least < last and (c > 2 or shiftright(large, 24) * 4 <= shiftright(small, 24) * 5)")
        found = saved(rows.join(shared.select("token"), "token").select(
            "token", "vertex", F.shiftright("shape", 24).cast("int").alias("n"),
            F.shiftright("shape", 8).bitwiseAND(0xFFFF).cast("int").alias("rank"),
            F.col("shape").bitwiseAND(0xFF).cast("int").alias("rare")).distinct(), "entries")
        entries = found if entries is None else entries.unionAll(found)
        delete(spark, f"{path}/part={number}")
        release(spark)
    return entries


def _regrouped(grouped: DataFrame, links: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Every document that has just been linked joins its partner's group.

    A group that is still two of those that the links connect costs comparisons only.
    """
    own = grouped.select(F.col("vertex").alias("b"), F.col("group").alias("to")).distinct()
    moves = links.join(own, "b").select(F.col("a").alias("vertex"), "to")
    moves = saved(moves.groupBy("vertex").agg(F.min("to").alias("to")), "moves")
    used.append(moves)
    return grouped.join(moves, "vertex", "left").select(
        "token", "vertex", "n", "rank", "rare", F.coalesce("to", "group").alias("group"))


def _leaders(grouped: DataFrame, turn: int, used: list[DataFrame]) -> DataFrame:
    """Pairs (a, b): for each document the leader of another group that it shares most with.

    Leaders are per token and class of sizes; in every other turn the classes are shifted by
    half, so that sizes close to a border meet too.
    """
    size_class = F.floor(F.log("n") / F.log(F.lit(1.25)) + 0.5 * (turn % 2)).cast("int")
    classed = grouped.withColumn("class", size_class)
    leaders = saved(classed.groupBy("token", "class").agg(F.min(F.struct(
        "rare", F.col("vertex").alias("b"), F.col("n").alias("m"),
        F.col("group").alias("other"))).alias("it")), "leaders")
    used.append(leaders)
    return (
        classed.join(leaders, ["token", "class"]).where(F.col("group") != F.col("it.other"))
        .groupBy(F.col("vertex").alias("a"), F.col("it.b").alias("b"))
        .agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("it.m").alias("m"))
        .where(_room(F.col("c"), F.col("n"), F.col("m")))
        .groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
    )


def _between_groups(grouped: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Pairs (a, b) of documents in different groups that the token-group matrix leaves open."""
    mixed = saved(grouped.groupBy("token").agg(
        F.min("group").alias("g"), F.max("group").alias("h")).where("g < h").select("token"),
        "mixed")
    # Sets of n and m tokens with a common part of 4/9 (n + m) share a token whose rank is at
    # most (5 n - 4 m) / 9 in the one and (5 m - 4 n) / 9 in the other: 4 m is within the reach
    # of the first there, 4 n within that of the second.
    rows = saved(grouped.join(mixed, "token").withColumn("reach", F.expr("5 * n - 9 * rank")),
                 "queries")
    matrix = saved(rows.groupBy("token", "group").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("group_reach")),
        "matrix")
    met = rows.withColumnRenamed("group", "own").join(matrix, "token").where(
        "own > `group` and n * 5 >= least * 4 and most * 5 >= n * 4")
    early = F.expr("4 * n <= group_reach and 4 * least <= reach")
    opened = met.groupBy("vertex", "n", "group").agg(
        F.count("*").alias("c"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.max(F.when(early, F.col("reach"))).alias("reach")).where("reach is not null")
    n, c = F.col("n"), F.col("c")
    # The need for shared tokens is least at one end of the sizes in the group.
    low = F.greatest(F.col("least"), F.ceil(n * 4 / 5).cast("int"))
    high = F.least(F.col("most"), F.floor(n * 5 / 4).cast("int"))
    opened = saved(opened.where(_room(c, n, low) | _room(c, n, high)), "opened")
    used += [mixed, rows, matrix, opened]
    members = rows.select("group", F.col("vertex").alias("b"), F.col("n").alias("m")).distinct()
    return opened.join(members, "group").where(
        _room(c, n, F.col("m")) & (F.col("m") * 4 <= F.col("reach"))).select(
        F.col("vertex").alias("a"), "b").distinct()


ORACLE_SQL = """
with recursive words as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_sort(list_distinct(list_transform(range(1, len(w) - 3),
              lambda i: array_to_string(w[i:i + 4], ' ')))) end as s
  from words),
docs as materialized (select doc_id, len(s) as n, md5(array_to_string(s, chr(10))) as key, s from sets),
classes as materialized (
  select key, any_value(s) as s, any_value(n) as n, min(doc_id) as least from docs where n > 0 group by key),
tokens as materialized (select key, n, unnest(s) as token from classes),
edges as materialized (
  select a.key as a, b.key as b from tokens a join tokens b on a.token = b.token and a.key <> b.key
  group by a.key, b.key, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) as (
  select key, key from classes
  union select reach.a, edges.b from reach join edges on reach.b = edges.a),
components as (
  select reach.a as key, min(c.least) as component_id from reach join classes c on c.key = reach.b group by reach.a)
select d.doc_id, d.n as n_shingles, coalesce(c.component_id, d.doc_id) as component_id
from docs d left join components c on d.n > 0 and c.key = d.key
"""
