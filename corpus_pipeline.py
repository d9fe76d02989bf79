"""The corpus pipeline: five stages over documents, each by one training-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terralyn.llm import stages
from terralyn.llm.common import shared_folder

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.drop_repeated_lines),
    ("minhash_near_dedup", stages.keep_one_of_near_copies),
    ("suffix_array_dedup", stages.cut_repeated_passages),
    ("packing", stages.pack_sequences),
]

#: None: no stage but the filters can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
