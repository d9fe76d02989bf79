"""The pipeline's stages: each takes (spark, docs, sf_dir) and returns the documents that it keeps, changed or packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lines, near, packing, repeats, toxicity
from .queries import vocabulary

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents graded as toxic go. Rows are judged by themselves, so a row keeps its columns."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines that repeat an earlier one, all but word for word, go; documents stay."""
    return lines.without_repeats(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of near copies by shingles of five words, the document with the smallest id stays."""
    return near.without_copies(docs, words=5)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: passages that stand earlier in the corpus go; documents stay."""
    return repeats.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the kept documents as padded token sequences' pieces."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))
