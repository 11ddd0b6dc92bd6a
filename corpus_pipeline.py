"""Documents to packed training sequences: quality, exact copies, near-copies, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of `documents`. Nulls, empty texts, ties, repeated rows and empty tables are handled as each operator states.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shotloom.llm import exact_dedup, mixing, near_dedup, packing, quality_knn
from shotloom.llm.common import documents, fold
from shotloom.operators.staging import materialize

WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the neighbours vote down; the classifier learns from the labelled rows of the same fold as its query."""
    model = quality_knn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 3) != 1)
    return quality_knn.keep_good(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one with the smallest id stays."""
    return near_dedup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample to the target shares of source, language and topic."""
    return mixing.sample_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, WORD_MODEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_knn", quality),
    ("exact_dedup", exact_copies),
    ("minhash_bbit", near_copies),
    ("mixing_ipf", mixture),
    ("best_fit_packing", packed),
]

#: The first stage is a trained classifier, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in order, each written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
