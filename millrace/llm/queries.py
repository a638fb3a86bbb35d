"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.decontamination import contamination_report
from millrace.llm.exact_dedup import duplicate_report
from millrace.llm.minhash_dedup import near_duplicates
from millrace.llm.oracles import ORACLE_SQL
from millrace.llm.pseudonyms import pseudonym_report
from millrace.llm.quality_rules import quality_report
from millrace.llm.quote_linking import link_quotes
from millrace.llm.slot_sharding import shard_report
from millrace.llm.source_mixing import mix_report
from millrace.llm.suffix_dedup import repeats_report
from millrace.llm.token_counts import token_report
from millrace.llm.vector_codes import code_report
from millrace.llm.warc import archive_report
from millrace.llm.whitening import whitening_report


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(_table(spark, sf_dir, "conversations"))


def op3_prefix_filtered_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonym_report(_table(spark, sf_dir, "documents"))


def op5_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_table(spark, sf_dir, "documents"))


def op6_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(_table(spark, sf_dir, "documents"))


def op7_weak_supervision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"))


def op8_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_report(_table(spark, sf_dir, "documents"))


def op9_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(_table(spark, sf_dir, "documents"))


def op10_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(_table(spark, sf_dir, "pages"))


def op11_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_report(_table(spark, sf_dir, "documents"))


def op12_subspace_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(_table(spark, sf_dir, "embeddings"))


def op13_filtering_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_hyperminhash_dedup, op2_quotation_linking, op3_prefix_filtered_decontamination, op4_feistel_pseudonyms, op5_sainte_lague_mixing, op6_virtual_slot_sharding, op7_weak_supervision_quality, op8_difference_cover_dedup, op9_whole_token_counts, op10_zstd_warc, op11_block_naming_dedup, op12_subspace_whitening, op13_filtering_lloyd_codes)}
