"""One registered query per document operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.llm import collocations, exact_dedup, hard_negatives, language_id, licenses, mixing, near_dedup, packing, quality_knn, quality_outliers, secrets, token_counts, toxicity
from shotloom.llm.common import documents, fold

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), digest_all=True).drop("n_bytes")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), PIECE_MODEL, token_counts.new_cache_path(spark)).drop("content")


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_knn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 3) != 1)
    return quality_knn.predict(docs, model).withColumn("held_out", fold("doc_id", 3) == 1).select("doc_id", "held_out", "score", "predicted")


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 5) != 0)
    return toxicity.predict(docs, model).withColumn("held_out", fold("doc_id", 5) == 0).select("doc_id", "held_out", "score", "predicted")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), WORD_MODEL)


def op6_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_outliers.reject_outliers(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs, fold("doc_id", 3) != 1)
    return language_id.predict(docs, model).withColumn("held_out", fold("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score")


def op8_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.find(docs, secrets.fit(docs))
    many = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), lambda v: v == F.lit(k))).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    base = secrets.joined(F.filter("spans", lambda s: s["kind"] != "format"))
    return found.select("doc_id", *many, F.sha2(base, 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op9_minhash_bbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), words=4, percent=80)


def op10_mixing_ipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op11_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] == "base")
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        licenses.label_list(base).alias("base_labels"), licenses.label_list(F.col("spans")).alias("labels"), "score",
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_exact_dedup, op2_token_counts, op3_quality_knn, op4_toxicity_cnn, op5_best_fit_packing, op6_quality_outliers, op7_language_id, op8_secret_grammar, op9_minhash_bbit, op10_mixing_ipf,
        op11_license_templates, op12_collocations, op13_hard_negatives,
    )
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op10_mixing_ipf": mixing.oracle_sql(),
    "op12_collocations": collocations.oracle_sql(),
    "op13_hard_negatives": hard_negatives.oracle_sql(),
}
