"""A training corpus from raw documents: each stage keeps, cuts or encodes what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from watchtide.llm import stages
from watchtide.llm.common import stash, table

STAGES = [
    ("quality_classifier", stages.keep_good),
    ("simhash_near_dedup", stages.near_dedup),
    ("suffix_array_dedup", stages.cut_repeats),
    ("benchmark_decontamination", stages.decontaminate),
    ("sentencepiece_encoding", stages.encode),
]

# No SQL form: the stages need trained models and 64-bit hashes; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
