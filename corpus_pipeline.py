"""A training corpus from the table documents: stages of the operators in quarry.llm, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, common, mixing, quality, simhash, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.7."""
    return quality.kept(docs, common.table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    return toxicity.kept(docs, common.table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies (five-word shingles, similarity 0.8 or more) the one with the smallest id."""
    common.ship(spark)
    return simhash.kept(docs, simhash.WIDE)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, once for each pass over a source."""
    common.ship(spark)
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each row."""
    common.ship(spark)
    return bpe.encode(docs, bpe.Settings(chunk=6 << 20), digests=True)  # smaller chunks than alone: the ids of a chunk are held too


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the classifiers nor the permutations; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet to the shared scratch folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
