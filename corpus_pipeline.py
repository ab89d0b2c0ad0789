"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes every stage's result to the shared checkpoint folder and rereads it as the next one's input, so a lost
executor repeats at most one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from athlos.llm import bpe, common, line_dedup, minhash, quality_rules, wumanber
from athlos.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave the fences of their language and source go."""
    common.bound_batches(spark)
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within two byte edits of an earlier line are cut; documents left blank by that go."""
    common.bound_batches(spark)
    return line_dedup.remove(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingle similarity of 0.8 or more stays."""
    common.bound_batches(spark)
    return minhash.dedupe(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return wumanber.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of the decoded bytes."""
    common.bound_batches(spark)
    return bpe.encode_decoded(docs, bpe.default_vocabulary())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("minhash_dedup", near_duplicates),
          ("decontamination", decontaminate), ("byte_bpe", tokens)]

# Byte-level BPE has no SQL form; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
