"""The training-data pipeline: from raw documents to token ids.

Each stage calls one operator of ``fanweave.llm`` on all rows that its predecessor kept. ``run``
writes each result as Parquet in the shared folder and reads it again for the next stage. All but
the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fanweave.llm import decontaminate, piece_transducer, repeats, simhash, toxicity
from fanweave.llm.common import materialize, table


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of smallest id."""
    return simhash.keep_one(docs)


def stage_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur again leave the texts; no document goes. The operator
    searches by bytes: PASSAGE, 200, are fewer than such a passage has in running text."""
    return repeats.remove_repeats(docs, repeats.PASSAGE)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text that is left, and proof that they decode to it."""
    return piece_transducer.encode_documents(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("simhash_near_duplicates", stage_simhash),
    ("suffix_array_repeats", stage_repeats),
    ("benchmark_decontamination", stage_decontaminate),
    ("sentencepiece", stage_encode),
]

# SQL expresses neither the string-kernel machine nor XXH64, byte windows or piece merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
