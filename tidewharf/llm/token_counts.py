"""Token counts: one exact histogram of encoded lengths answers every context limit.

Documents are encoded, and only the histogram of their lengths goes on: how many documents
have how many tokens. Sums from the long end give, for each length, the documents and tokens
at least that long; with them the total, any quantile and the total after cutting documents
at any limit follow without touching a document again.

The sums are made in two levels, over ranges of lengths and within each range, so that no
task gets more than the ranges or the lengths of one range.

Defined results: a null or empty text has 0 tokens and counts as a document; no documents
give an empty histogram; texts that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewharf.llm.common import lean, saved

#: Lengths in a range.
RANGE = 1024


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank)
                for token, rank in (line.split() for line in file if line.strip())}


def with_lengths(documents: DataFrame, ranks: dict[bytes, int], pattern: str, *,
                 text_col: str = "text", length_col: str = "n_tokens") -> DataFrame:
    """All columns of ``documents`` with the number of tokens; that column is replaced."""
    before = documents.drop(length_col)
    names = before.columns
    at = names.index(text_col)
    schema = T.StructType([*before.schema.fields, T.StructField(length_col, T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks,
                                     special_tokens={})
        for batch in batches:
            lengths = [len(encoding.encode_ordinary(t.as_py())) if t.is_valid else 0
                       for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lengths, pa.int64())], names=[*names, length_col])

    return before.mapInArrow(lean(counted), schema)


def histogram(lengths: DataFrame, *, length_col: str = "n_tokens") -> DataFrame:
    """One row per length: n_docs, and what is known of documents at least and at most that long.

    ``truncated_tokens`` is the total if documents are cut at ``length``.
    """
    counts = lengths.groupBy(F.col(length_col).cast("bigint").alias("length")).agg(
        F.count("*").alias("n_docs"))
    # Stored, as it is used twice and the documents are to be encoded once.
    counts = saved(counts.where("length is not null"), "lengths").withColumn(
        "range", F.floor(F.col("length") / RANGE)).withColumn("n_tokens", F.expr("length * n_docs"))
    ranges = counts.groupBy("range").agg(
        F.sum("n_docs").alias("range_docs"), F.sum("n_tokens").alias("range_tokens"))
    # One row for each RANGE lengths: the only step in a single task.
    longer = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("range")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    above = ranges.select(
        "range",
        F.coalesce(F.sum("range_docs").over(longer), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("range_tokens").over(longer), F.lit(0)).alias("tokens_above"),
        F.sum("range_docs").over(every).alias("total_docs"),
        F.sum("range_tokens").over(every).alias("total_tokens"))
    within = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        counts.join(above, "range")
        .withColumn("docs_at_least", F.sum("n_docs").over(within) + F.col("docs_above"))
        .withColumn("tokens_at_least", F.sum("n_tokens").over(within) + F.col("tokens_above"))
        .select(
            "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least",
            "total_docs", "total_tokens",
            F.expr("total_tokens - tokens_at_least + length * docs_at_least").alias(
                "truncated_tokens"),
            F.expr("(total_docs - docs_at_least + n_docs) / total_docs").alias("share_up_to"))
    )


def at_limits(counts: DataFrame, limits: DataFrame, *, limit_col: str = "limit") -> DataFrame:
    """Documents longer than each limit, and the total of tokens if cut at it.

    The limits are a stated, short list; a limit takes the least length that is not below it.
    """
    wanted = limits.select(F.col(limit_col).cast("bigint").alias("limit")).where(
        "limit is not null").distinct()
    # Limits meet the histogram, never documents; both are bounded by distinct lengths.
    met = wanted.join(counts, F.col("length") > F.col("limit"), "left")
    longer = met.groupBy("limit").agg(
        F.coalesce(F.max("docs_at_least"), F.lit(0)).alias("docs_longer"),
        F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("tokens_longer"))
    totals = counts.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total_tokens"))
    return longer.join(F.broadcast(totals)).select(  # one row
        "limit", "docs_longer", "total_tokens",
        F.expr("total_tokens - tokens_longer + limit * docs_longer").alias("truncated_tokens"))


def quantiles(counts: DataFrame, shares: list[float]) -> DataFrame:
    """For each share, the least length that at least this share of documents does not exceed."""
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    return counts.select("length", "share_up_to", wanted).where(
        "share_up_to >= share").groupBy("share").agg(F.min("length").alias("length"))
