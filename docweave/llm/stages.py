"""The stages of corpus preparation: each takes the rows that the stage before has kept and returns the columns of documents, but for the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import decontamination, mixing, neardup, quality, sharding


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules.

    Null, empty and very short texts fail; equal rows are judged alike; an unknown or null language is one of its own. An empty table gives no rows.
    """
    return quality.kept_documents(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates. Of rows that repeat that doc_id, one stays.

    Texts without words (null ones too) link with nothing and stay. An empty table gives no rows.
    """
    return neardup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark passage. Null and empty texts have none; an empty benchmark hits nothing."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target of its source asks for; null is a source. Rows of one id are drawn alike."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal texts together in 16 shards of near equal bytes. Null texts count as empty and have a place too."""
    return sharding.shard_by_bytes(docs)
