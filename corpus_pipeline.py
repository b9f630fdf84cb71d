"""The corpus pipeline: language, lines, near-duplicates, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import encode_stage
from tidemark.llm.common import cut, table
from tidemark.llm.language import language_stage
from tidemark.llm.linededup import line_stage
from tidemark.llm.mixing import mixing_stage
from tidemark.llm.simhash import dedup_stage

#: (name, function of (spark, docs, sf_dir)); each takes what the one before has written.
STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", encode_stage),
]

#: SQL can't express the automata, fingerprints and merges; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
