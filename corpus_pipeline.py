"""Raw documents to token ids: each stage works on all that the one before kept, and is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.common import stored, table

STAGES = [
    ("quality classifier", stages.quality_stage),
    ("language ID", stages.language_stage),
    ("MinHash near-dedup", stages.near_duplicate_stage),
    ("benchmark decontamination", stages.decontamination_stage),
    ("byte-level BPE encoding and decoding", stages.encoding_stage),
]

#: The classifiers and the tokenizer have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
    return docs
