"""Connected components of a graph given by its edges, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewharf.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """``v, root`` for every vertex with an edge; the root is the component's least vertex.

    ``edges`` has columns ``a`` and ``b``. Each round links neighbours of a vertex to
    the least of them, first those above it, then those below, until nothing changes.
    A vertex with very many neighbours has one row a task in the minimum and a join that adaptive
    execution can split; nothing is collected. No edges give no rows.
    """
    pairs = saved(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(pairs)
    while state[0]:
        pairs = saved(_to_least(_both_ways(pairs)), "edges")
        pairs = saved(_below(pairs), "edges")
        state, before = _state(pairs), state
        if state == before:
            break
    roots = pairs.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return saved(roots.unionAll(roots.select(F.col("root").alias("v"), "root")).distinct(), "roots")


def _state(pairs: DataFrame) -> tuple:
    # Decimal, as a sum of 64-bit hashes would overflow.
    sums = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(sums)


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _to_least(pairs: DataFrame) -> DataFrame:
    least = saved(pairs.groupBy("a").agg(F.min("b").alias("m")), "least")
    found = pairs.join(least, "a").where("b > a")
    return found.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _below(pairs: DataFrame) -> DataFrame:
    # After the first step a vertex has few neighbours below it.
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    others = pairs.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
