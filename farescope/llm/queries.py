"""The registered query of every operator: (spark, sf_dir) -> digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farescope.llm import (
    chunk_bpe, fill_middle, importance, language, line_dedup, mixing, ngram_join, packing, quality, secret_ledger,
    suffix_dedup, topk, toxicity,
)
from farescope.llm.common import read_table
from farescope.llm.oracles import ORACLE_SQL  # noqa: F401  (registered beside QUERIES)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate(
            "spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"]
        ).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op3_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(read_table(spark, sf_dir, "documents"))


def op3_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.count_links(read_table(spark, sf_dir, "documents"))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.find_secrets(read_table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["nth"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(secret_ledger.RULES)]
    joined = secret_ledger.listed(F.col("spans"))
    return found.select(
        "doc_id", *counts, sha256(joined).alias("base_sha256"), joined.alias("spans")
    )


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op6_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(
        read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ).select("doc_id", "n_lines", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


def op8_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op9_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op10_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(table, F.col("vec_id") % 100 == 0)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (read_table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return importance.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def op12_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = chunk_bpe.decode(chunk_bpe.encode(read_table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256(F.col("text")).alias("decoded_sha256"),
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fill_middle.transform(read_table(spark, sf_dir, "documents"))
    return moved.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        sha256(F.col("output")).alias("output_sha256"),
        sha256(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_lexicon_toxicity": op2_lexicon_toxicity,
    "op3_signature_tree_join": op3_signature_tree_join,
    "op3_link_counts": op3_link_counts,
    "op4_secret_ledger": op4_secret_ledger,
    "op5_pareto_mix": op5_pareto_mix,
    "op6_bin_slack_packing": op6_bin_slack_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_word_backoff_language": op8_word_backoff_language,
    "op9_adaptive_quality": op9_adaptive_quality,
    "op10_histogram_topk": op10_histogram_topk,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_chunk_bpe": op12_chunk_bpe,
    "op13_fill_middle": op13_fill_middle,
}
