"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, sharding.

Each stage reads what the one before kept. Every stage but the last returns the columns of
``documents``; the last adds ``virtual_slot`` and ``shard``.

Rows are judged by their own text. Null and empty texts are scored like texts without words, are
equal to their like, hold no benchmark item, weigh nothing in the mix and have a shard. Rows
without a doc_id or with a shared one stay or go one by one, but in near-dedup, where of a class
the row of least doc_id stays and equal (doc_id, text) rows are one. Long texts are read whole.
Extra columns go along; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandweave.llm import decontaminate, mixing, neardup, sharding, toxicity
from strandweave.llm._arrow import small_batches
from strandweave.llm._shared import shared_dir
from strandweave.operators._store import scratch


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity trees score below the threshold stay, one by one."""
    small_batches(spark)
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the row with the least doc_id stays; a class without any keeps one row."""
    small_batches(spark)
    return neardup.keep_first(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item stay, one by one, whatever their doc_id."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in training order, repeated or left out as the curriculum's targets say; null sources are a source, texts without words cost nothing."""
    return mixing.mix_documents(docs)


def stage_shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix dealt to shards by virtual slots of (doc_id, text); null ids and texts are keys like others."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
    ("shard", stage_shard),
]

#: No stage before the last is SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again in the shared folder, and what a stage kept on the way goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark).rstrip('/')}/strandweave/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}-{name}")
        docs = spark.read.parquet(f"{home}/{k}-{name}")
    return docs
