"""From raw documents to packed token sequences, stage by stage.

Every stage gets all rows that the one before left, from a table in the shared folder, so a lost
executor costs at most the stage it was in. A stage writes two files to each split of its input at most.

Defined cases: an empty table gives an empty result; without labels nothing is taken for toxic; NULL and
empty texts pass the filters as documents without words; rows that share an id are one document to the
n-gram join and stay or go together, and rows without an id stay; very long texts go through whole; columns beyond those of documents are
kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farescope.llm import line_dedup, mixing, ngram_join, packing, toxicity
from farescope.llm.common import files_for, read_table, saved


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by a model learned from the labelled ones."""
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, model)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that another one keeps."""
    return (
        line_dedup.dedup_lines(docs)
        .withColumn("n_chars", F.length("text").cast("long"))
        .select(*docs.columns)
        .coalesce(files_for(docs))
    )


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that similarity links."""
    return ngram_join.one_of_each(docs).coalesce(files_for(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs).coalesce(files_for(docs))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_shared_lines),
    ("ngram_join", one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

# The first stage learns a model, which SQL cannot express; tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
