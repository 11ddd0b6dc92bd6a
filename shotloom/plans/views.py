"""Fixture views: the driver tables in the shape of the library's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import round_at, text_importance
from ..operators.ordered import id_bucket, with_neighbors, with_ordinal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("start_sec", epoch(F.col("ts")))


def day(c: str = "start_sec") -> Column:
    """Order-preserving bucket of a time column."""
    return F.floor(F.col(c) / 86400.0)


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type = 'view'").select(
        F.col("user_id").cast("string").alias("video_id"),
        F.concat(F.lit("shot_"), F.col("event_id")).alias("shot_id"),
        F.col("event_id").alias("seq"),
        "start_sec",
    )
    e = with_neighbors(e, ["video_id"], ["start_sec", "seq"], day(), next_={"end_sec": "start_sec"})
    return e.where(F.col("end_sec").isNotNull())


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'click'").select(
        F.col("user_id").cast("string").alias("video_id"),
        F.concat(F.lit("sub_"), F.col("event_id")).alias("segment_id"),
        F.col("event_id").alias("seq"),
        "start_sec",
        (F.col("start_sec") + F.col("value") * 3600).alias("end_sec"),
        F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("text"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ordered units of a video."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("video_id"), "doc_id", "text")
    return with_ordinal(d, ["video_id"], [F.col("doc_id")], id_bucket(F.col("doc_id"), 4096), total="card_count")


def card_fields(df: DataFrame) -> DataFrame:
    """Heuristic card columns of units that carry ``ord`` and ``text``."""
    keys = tx.keywords(F.col("text"), 4)
    body = tx.strip(F.col("text"))
    d = df.withColumn("_k", keys)
    return d.select(
        "video_id",
        *[c for c in ("doc_id", "card_count") if c in df.columns],
        "ord",
        F.format_string("shot_%03d", "ord").alias("shot_id"),
        (F.col("ord") * 10.0).alias("start_sec"),
        (F.col("ord") * 10.0 + 8).alias("end_sec"),
        F.col("text").alias("merged_summary"),
        F.when(F.size("_k") > 0, F.slice("_k", 1, 3)).otherwise(F.array(F.lit("内容提取"))).alias("topic_tags"),
        F.col("_k").alias("key_entities"),
        F.when(F.length(body) > 0, "explanation").otherwise("unknown").alias("narrative_role"),
        round_at(text_importance(body), 3).alias("importance_score"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_fields(texts(spark, sf_dir))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("video_id"), "vec_id", F.col("embedding").cast("array<double>").alias("e")
    )
    e = with_ordinal(e, ["video_id"], [F.col("vec_id")], id_bucket(F.col("vec_id"), 4096))
    scaled = lambda a: F.transform(a, lambda x: F.abs(x) * 255)
    return e.select(
        "video_id",
        (F.col("ord") - 1).alias("frame_idx"),
        scaled(F.slice("e", 1, 32)).alias("gray"),
        scaled(F.slice("e", 33, 32)).alias("edge"),
        F.transform("e", lambda x: x * x).alias("hist"),
    )


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as the ordered units of a chapter (a handful per chapter)."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("chapter_id"),
        F.col("l_quantity").cast("int").alias("shot_count"),
        "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice",
    )
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")]
    return with_ordinal(li, ["chapter_id"], order, id_bucket(F.col("l_linenumber"), 256)).drop("l_shipdate", "l_extendedprice")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("event_type") == "error") | (F.col("value") > 20)
    return events(spark, sf_dir).select(
        F.col("event_id").alias("call_id"),
        F.col("event_type").alias("function"),
        "user_id",
        F.col("start_sec").alias("time"),
        F.when(failed, "failure").otherwise("success").alias("status"),
        F.when(F.col("event_id") % 3 == 0, "provider_call").otherwise("function_call").alias("record_type"),
        F.col("value").alias("elapsed_sec"),
        F.col("props").alias("payload"),
        F.when(F.col("event_type") == "error", "Connection reset by peer")
        .when(F.col("value") > 20, "Request timed out")
        .alias("error"),
    )
