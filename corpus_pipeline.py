"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing, SentencePiece ids.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Nulls, empty
and very long texts, repeated rows, empty tables and extra columns are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import line_dedup, mixing, pieces, quality, simhash
from tidemark.llm.common import cut, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host is rejected, go."""
    return quality.keep(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or nearly, go; every document stays."""
    return line_dedup.drop_lines(docs, short=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, once or not at all, as their source's target weight asks."""
    return mixing.repeat_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_chunks, exact of each document."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", near_dedup),
    ("mixing to target weights", mix),
    ("sentencepiece", encode),
]

#: No SQL: edit distances, fingerprints and merges of the stages aren't expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
