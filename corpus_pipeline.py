"""From raw documents to shards: the stages of corpus preparation, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import stages
from docweave.llm.shared import new_path, release

STAGES = [
    ("quality rules", stages.good),
    ("near duplicates", stages.deduplicated),
    ("benchmark decontamination", stages.decontaminated),
    ("mix sources", stages.mixed),
    ("shards", stages.sharded),
]

#: The stages draw on hashes and trained references, which SQL alone doesn't give; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents.

    Once a stage's rows are written, the tables behind them (the rows of the stage before among these) are removed. What stands behind the
    DataFrame that this call returns stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        rows, path = stage(spark, docs, sf_dir), new_path(spark, "pipeline")
        rows.write.parquet(path)
        docs = spark.read.parquet(path)
        release(rows)
    return STAGES[-1][1](spark, docs, sf_dir)
