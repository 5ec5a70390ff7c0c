"""From raw documents to shuffled training shards: five stages, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from upswell.llm import decontaminate, mixing, quality, sharding, simhash
from upswell.session import apply_conf, shared_dir, stages


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose best grade is likelier than not."""
    apply_conf(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id."""
    apply_conf(spark)
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    apply_conf(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document taken twice is there twice."""
    apply_conf(spark)
    return mixing.take(docs)


def shuffle_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    apply_conf(spark)
    return sharding.shuffled_shards(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mix_to_weights),
    ("sharding", shuffle_into_shards),
]

#: A trained model and seeded shuffles in NumPy have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each result is written to the shared folder and reread.

    What a stage wrote on its way goes when its result is written. An empty table stays
    empty through all stages; texts of any length pass as a whole. Rows that repeat are told
    apart as each operator says.
    """
    apply_conf(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for nth, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{nth}"
        with stages(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
