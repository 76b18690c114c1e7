"""The corpus pipeline: classify, drop repeated lines, drop near copies, redact, pack.

Each stage takes what the one before it kept, as a table that was written and read again. All but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairstone.llm import icws, line_dedup, packing, pii, quality
from pairstone.llm.runtime import checkpointed, crc_bucket, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from labels of the documents at hand."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), crc_bucket(F.col("doc_id"), 5) != 0)
    return quality.keep_good(docs, model)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that earlier ones have; those that lose every line go."""
    return line_dedup.strip_repeats(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return icws.keep_one(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the names of its kinds."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_documents),
    ("line_dedup", fresh_lines),
    ("minhash_near_dedup", one_of_each),
    ("pii", redacted),
    ("best_fit_packing", packed),
]

#: SQL can't express the classifier, the samples, the scored contexts and the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
