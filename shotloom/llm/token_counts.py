"""Token counts kept in a cache of content and tokenizer digests; only distinct misses are encoded."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.llm.common import lookup, released, ship, text_slices
from shotloom.operators.staging import materialize, staging_dir

CACHE_SCHEMA = "content string, tokenizer string, n_tokens bigint"
TOKEN_LIMIT = 4096

_loaded: dict[str, sentencepiece.SentencePieceProcessor] = {}


def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _loaded:
        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


def tokenizer_digest(model_path: str) -> str:
    """SHA-256 of the model file and of the library version: a new version of either never meets old counts."""
    with open(model_path, "rb") as f:
        return hashlib.sha256(f.read() + sentencepiece.__version__.encode()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Stored counts; an empty table where nothing has been appended yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def new_cache_path(spark: SparkSession) -> str:
    return f"{staging_dir(spark)}/token-cache-{uuid.uuid4().hex}"


def count_tokens(docs: DataFrame, model_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per input row: `id_col`, n_bytes, n_tokens, over_limit, content (SHA-256 of the text).

    Content is normalised only by reading null as empty, since any other change could change a count. Contents that the
    cache lacks for this tokenizer are found on digests alone; their texts are then brought together by digest, one row
    per digest leaving each task, encoded once and appended to the cache. The cache is written before it is read back, so
    a lost executor repeats a task and no count is lost. If two runs append the same digest, one row of it is used.

    Empty text has 0 tokens; repeated rows and copies share one count; an empty table gives an empty result and appends
    nothing. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    version = tokenizer_digest(model_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("content", F.sha2("_text", 256))
    keys = materialize(keyed.select("_id", "content", F.octet_length("_text").cast("long").alias("n_bytes")))
    stored = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).select("content").distinct()
    sizes = materialize(keys.groupBy("content").agg(F.count("*").alias("_n")))
    misses = sizes.join(stored, "content", "left_anti").select("content")
    some = keyed.select("content", "_text")
    if stored.take(1):  # with an empty cache every content is a miss
        some = some.join(misses, "content", "left_semi")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(model_path)
        for b in batches:
            texts, counts = b["_text"].tolist(), []
            for lo, hi, _ in text_slices(texts):
                counts += [len(ids) for ids in model.encode(texts[lo:hi], num_threads=1)]
            yield pd.DataFrame({"content": b["content"], "tokenizer": version, "n_tokens": pd.Series(counts, dtype="int64")})

    some.dropDuplicates(["content"]).mapInPandas(released(encode), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counts = read_cache(spark, cache_path).filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    found = lookup(keys, counts.join(sizes, "content"), "content", "_n")
    return found.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content")
