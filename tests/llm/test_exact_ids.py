"""Ids beyond 2^53 beside a null id come back as they are from every operator that works on pandas batches."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shotloom.llm import language_id, near_dedup, packing, quality_knn, quality_outliers, secrets, toxicity

BIG = 1 << 60
IDS = [BIG + 1, None, BIG + 3]


@pytest.fixture
def docs(docs_of):
    rows = [(i, f"text number {k} with some more words in it and a token: abcdef{k}") for k, i in enumerate(IDS)]
    return docs_of(rows).withColumn("n_chars", F.when(F.col("doc_id") == BIG + 3, BIG + 5)).coalesce(1)


@pytest.mark.parametrize("apply", [
    lambda d: quality_knn.predict(d, None), lambda d: language_id.predict(d, None), lambda d: secrets.find(d, None), quality_outliers.reject_outliers, near_dedup.near_duplicates,
    lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
], ids=["op3", "op7", "op8", "op6", "op9", "op5"])
def test_ids_stay(docs, apply):
    assert Counter(r.doc_id for r in apply(docs).collect()) == Counter(IDS)


def test_ids_stay_in_toxicity(spark, docs, docs_of):
    learn = docs_of([(k, "vile awful trash" if k % 2 else "kind warm words") for k in range(40)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id bigint, quality int, toxic int")
    assert Counter(r.doc_id for r in toxicity.predict(docs, toxicity.fit(learn, labels, F.lit(True))).collect()) == Counter(IDS)


def test_all_columns_stay_in_the_quality_filter(docs):
    assert {(r.doc_id, r.n_chars) for r in quality_knn.keep_good(docs, None).collect()} == {(BIG + 1, None), (None, None), (BIG + 3, BIG + 5)}


def test_near_copies_with_neighbouring_ids(docs_of):
    text = "one two three four five six seven eight nine ten"
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs_of([(BIG + 1, text), (BIG + 2, text), (BIG + 3, "all other words stand here in this one"), (None, "null id words here for sure")]).coalesce(1)).collect()}
    assert got == {BIG + 1: (BIG + 1, True), BIG + 2: (BIG + 1, False), BIG + 3: (BIG + 3, True), None: (None, True)}
