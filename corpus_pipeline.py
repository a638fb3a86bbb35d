"""The corpus pipeline: quality rules, near-dedup, decontamination, source mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and
reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.decontamination import decontaminate
from millrace.llm.minhash_dedup import drop_near_duplicates
from millrace.llm.quality_rules import filter_quality
from millrace.llm.slot_sharding import sharded
from millrace.llm.source_mixing import apply_mix
from millrace.staging import stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and whose posterior of good quality reaches one half; null and empty texts go."""
    return filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group, that with the smallest doc_id; documents without words stay."""
    return drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of ``benchmark`` occurs; null texts stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it; one without words is not taken."""
    return apply_mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs, then shard, slot and virtual_slot, which replace columns of these names."""
    added = ("shard", "slot", "virtual_slot")
    kept = [c for c in docs.columns if c not in added]
    return sharded(docs, kept).select(*[f"row.`{c}`" for c in kept], *[f"_sh.{c}" for c in added])


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", near_dedup),
    ("decontamination", remove_benchmark),
    ("source_mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Sketches, expectation-maximisation and the slot map have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
