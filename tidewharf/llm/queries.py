"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewharf.llm import (
    collocations, decontaminate, jaccard, licenses, lines, passages, periods, pii, secrets,
    sentencepiece_bpe, syncmers, token_counts, toxicity,
)
from tidewharf.llm.common import read


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: source/language/hundred of ids/id.

    The table has no paths; in this tree a short document with a license is the licence
    file of its directory, as the operator has it for any file.
    """
    files = read(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat_ws(
            "/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")),
            F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"),
        ).alias("path"))
    return licenses.scan(files).select(
        "doc_id", "path", "license", "cosine", "origin", "licensed_by")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"),
    )


def op3_token_counts(
    spark: SparkSession, sf_dir: str, ranks_path: str | None = None,
) -> DataFrame:
    ranks = token_counts.load_ranks(
        ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_counts.histogram(token_counts.with_lengths(
        read(spark, sf_dir, "documents").select("text"), ranks, public_tokenizers.PATTERN))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")

    def base(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *[base(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_disguised"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        F.col("n").cast("bigint").alias("n_shingles"),
        F.col("component").alias("component_id"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_boilerplate(
        read(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def op7_sentencepiece(
    spark: SparkSession, sf_dir: str, model_path: str | None = None,
) -> DataFrame:
    model = sentencepiece_bpe.load_model(
        model_path or public_tokenizers.path("piece_bpe_32k.model"))
    encoded = sentencepiece_bpe.encode(
        read(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    return sentencepiece_bpe.decode(encoded, model).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    lexicon = toxicity.learn(documents, toxicity.training_rows(labels))
    return toxicity.score(documents, lexicon).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "n_matches",
    )


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.col("begin").cast("bigint").alias("begin_word"),
        F.col("end").cast("bigint").alias("end_word"), F.col("other_id").alias("other_doc_id"),
        F.col("other_begin").cast("bigint").alias("other_begin_word"),
        F.col("other_end").cast("bigint").alias("other_end_word"),
        F.round("identity", 6).alias("identity"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_next(
        read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no repositories: a source is an owner, and its languages are its repositories."""
    documents = read(spark, sf_dir, "documents")
    found = secrets.scan(
        documents.select("doc_id", "text", "source", "lang"), F.col("source"), F.concat_ws(
            "/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-"))))

    def number(condition) -> Column:
        return F.size(F.filter("spans", condition)).cast("bigint")

    def of_kind(i: int) -> Column:
        return number(lambda s: s["kind"] == i).alias(f"n_{secrets.KINDS[i][0]}")

    return found.select(
        "doc_id",
        *[of_kind(i) for i in range(secrets.BASE_KINDS)],
        F.sha2(secrets.listed(F.filter(
            "spans", lambda s: s["kind"] < secrets.BASE_KINDS)), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
        number(lambda s: s["verdict"] == "live").alias("n_live"),
        number(lambda s: s["verdict"] == "example").alias("n_example"),
        secrets.listed(F.filter("spans", lambda s: s["verdict"] == "live")).alias("live_spans"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found = periods.runs(documents.select(
        "doc_id", periods.echoed(F.col("text"), F.col("doc_id")).alias("text"))).drop("text")
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    return found.withColumn("top", F.when(F.size("runs") > 0, longest)).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.l")).alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * (-top.l) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(
            F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]),
            F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


QUERIES = {
    "op1_licenses": op1_licenses,
    "op2_decontamination": op2_decontamination,
    "op3_token_counts": op3_token_counts,
    "op4_pii": op4_pii,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_line_dedup": op6_line_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_toxicity": op8_toxicity,
    "op9_passages": op9_passages,
    "op10_fingerprints": op10_fingerprints,
    "op11_secrets": op11_secrets,
    "op12_collocations": op12_collocations,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op5_jaccard_join": jaccard.ORACLE_SQL,
    "op6_line_dedup": lines.ORACLE_SQL,
    "op11_secrets": secrets.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_periodic_runs": periods.ORACLE_SQL,
}
