"""A training corpus from raw documents, in five stages that each keep the table's columns.

Each stage works on all that the one before it kept, written as Parquet and read again.
The first needs ``labels`` and the fourth ``benchmark`` of the same folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewharf.llm import decontaminate, jaccard, lines, sentencepiece_bpe, toxicity
from tidewharf.llm.common import read, saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a score below one half; the lexicon is learned from the labels."""
    labels = toxicity.training_rows(read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    lexicon = toxicity.learn(docs, labels)
    return toxicity.score(docs.select(COLUMNS), lexicon).where("score < 0.5").select(COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take boilerplate lines out of the texts; every document stays."""
    return lines.remove_boilerplate(docs.select(COLUMNS)).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint"))
        .otherwise(F.col("n_chars"))).select(COLUMNS)


def _with_key(docs: DataFrame) -> DataFrame:
    """``__key`` is the same for rows of the same id and text only."""
    return docs.select(COLUMNS).withColumn("__key", F.concat_ws(
        ":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
        F.md5(F.coalesce("text", F.lit(""))), F.col("text").isNull().cast("string")))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents keep the least id; documents without words stay."""
    keyed = _with_key(docs)
    found = saved(jaccard.similar(keyed, carry=("__key",)), "similar")
    # Null ids come after all others.
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "__key"))
    kept = saved(found.where("root is not null").groupBy("root").agg(first.alias("kept")).select(
        "kept.__key"), "kept")
    # Rows of the same id and text are copies too; rows without words are no copies.
    chosen = keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key"])
    bare = saved(found.where("root is null").select("__key").distinct(), "bare")
    return chosen.unionByName(keyed.join(bare, "__key", "left_semi")).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold any window of a benchmark item."""
    keyed = _with_key(docs)
    found = decontaminate.contamination(
        keyed, read(spark, sf_dir, "benchmark"), id_col="__key").where("n_hit > 0")
    bad = saved(found.select("__key").distinct(), "contaminated")
    return keyed.join(bad, "__key", "left_anti").select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the ids of each text and the text that they decode to."""
    model = sentencepiece_bpe.load_model(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = sentencepiece_bpe.encode(docs.select(COLUMNS), model)
    return sentencepiece_bpe.decode(encoded, model).select(
        *COLUMNS, F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", drop_similar),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-').lower()}")
    return docs


# Several stages are beyond SQL; tests/llm holds them against plain versions.
ORACLE_SQL = None
