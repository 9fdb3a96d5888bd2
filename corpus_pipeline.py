"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, benchmark decontamination, byte-level BPE.

Every stage works on all that its predecessor kept and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

import sys
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from umbraline.llm import bpe, decontaminate, jaccard_join, line_dedup, quality  # noqa: E402
from umbraline.llm.common import release, stored, table  # noqa: E402


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document that loses all its words goes."""
    return line_dedup.drop_repeats(docs)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more) stays, that with the smallest id."""
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, with the digests of the ids and of the decoded bytes."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_rules", quality_stage), ("line_dedup", line_stage), ("ngram_jaccard_join", join_stage),
    ("benchmark_decontamination", decontaminate_stage), ("byte_level_bpe", encode_stage),
]

#: Byte-pair merges cannot be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        release(spark)
    return docs
