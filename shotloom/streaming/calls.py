"""Call logs as streams.

A log may hold heartbeats: rows that have a time and nothing else. They move the watermark of a source that is idle or has
ended, so that its last windows and unmatched calls come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


from ..functions import numbers as num
from ..functions.text import error_category
from ..operators.calls import index_rows
from .folded import fold_in, folded

CALL_SCHEMA = (
    "call_id string, parent_call_id string, record_type string, function string, status string, error string, "
    "error_category string, elapsed_sec double, time timestamp, payload string, _corrupt_record string"
)


def read_calls(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Append-only line-JSON log as a stream; a broken line lands in ``_corrupt_record`` and never stops the job."""
    r = spark.readStream.schema(CALL_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.json(path)


def write_heartbeat(spark: SparkSession, path: str, time) -> None:
    """Append a heartbeat to a log. A log that has ended gets one that lies beyond its last time by all delays."""
    row = spark.createDataFrame([("heartbeat", time)], "record_type string, time timestamp")
    row.coalesce(1).write.mode("append").json(path)


def _sums(df: DataFrame) -> DataFrame:
    """Additive health counters per function; 'last' is decided by (time, call_id)."""
    return df.where("call_id is not null").groupBy(F.coalesce("function", F.lit("unknown")).alias("function")).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("record_type") == "function_call").alias("function_calls"),
        F.count_if(F.col("record_type") == "provider_call").alias("provider_calls"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "failure").alias("failure"),
        F.coalesce(F.sum("elapsed_sec"), F.lit(0.0)).alias("elapsed_sum"),
        F.max(F.struct("time", "call_id", "status", "error_category")).alias("last"),
    )


def _merged(parts: DataFrame) -> DataFrame:
    """Health counters of a function over all parts."""
    added = ("records", "function_calls", "provider_calls", "success", "failure", "elapsed_sum")
    return parts.groupBy("function").agg(*[F.sum(c).alias(c) for c in added], F.max("last").alias("last"))


def health_view(sums: DataFrame) -> DataFrame:
    n = F.greatest(F.lit(1), F.col("records"))
    return sums.select(
        "function", "records", "function_calls", "provider_calls", "success", "failure",
        num.round_at(F.col("success") / n, 4).alias("success_rate"), num.round_at(F.col("elapsed_sum") / n, 3).alias("elapsed_sec_avg"),
        F.col("last.status").alias("last_status"), F.col("last.error_category").alias("last_error_category"),
    )


def stream_call_health(calls: DataFrame, out: str, checkpoint: str, once: bool = True, every: int = 10) -> StreamingQuery:
    """Keep call health current. Each trigger adds the counters of its own rows; ``call_health_table`` reads them as one.

    The stream keeps no state. A replayed trigger rewrites its own part, so nothing counts twice; parts are merged every few triggers.
    """

    def write(batch: DataFrame, version: int) -> None:
        fold_in(_sums(batch), out, version, _merged, every)

    w = calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def call_health_table(spark: SparkSession, out: str) -> DataFrame:
    """Health per function over all triggers so far."""
    return health_view(folded(spark, out, _merged))


def stream_call_index(calls: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Details to redacted index rows, one folder per trigger and function; a replayed trigger rewrites its own folder."""

    def write(batch: DataFrame, version: int) -> None:
        index_rows(batch.where("call_id is not null")).write.mode("overwrite").partitionBy("function").parquet(f"{out}/version={version}")

    w = calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def _timed(cond: Column) -> Column:
    """A filter that Spark leaves above the watermark, since it is about the time; so that rows it drops still move the watermark."""
    return F.when(cond, F.col("time")).isNotNull()


def stream_errors(calls: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Error counts per window, stage and category; the watermark bounds the state.

    A window comes out once the watermark, which every row of the log moves, has passed its end; rows that come later than that are
    left out. A heartbeat closes the last windows of a log.
    """
    return (
        calls.withWatermark("time", delay).where(_timed(F.col("error").isNotNull()))
        .groupBy(F.window("time", window).alias("w"), F.col("function").alias("stage"), error_category(F.col("error")).alias("category"))
        .agg(F.count(F.lit(1)).alias("errors"))
        .select(F.col("w.start").alias("window_start"), "stage", "category", "errors")
    )


def stream_link_calls(function_calls: DataFrame, provider_calls: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Provider calls under their function call, if both lie within ``delay``; a function call without one comes out when the watermark has
    passed that span. A heartbeat in both logs brings out the last ones."""
    f = function_calls.withWatermark("time", delay).where(_timed(F.col("record_type") == "function_call")).select("call_id", F.col("time").alias("call_time"))
    p = provider_calls.withWatermark("time", delay).where(_timed(F.col("record_type") == "provider_call")).select(
        F.coalesce("parent_call_id", F.lit("")).alias("parent_call_id"),  # never null, else heartbeats would be dropped below the watermark
        F.col("call_id").alias("raw_call_id"), F.col("time").alias("raw_time"),
    )
    near = (F.col("raw_time") >= F.col("call_time") - F.expr(f"INTERVAL {delay}")) & (F.col("raw_time") <= F.col("call_time") + F.expr(f"INTERVAL {delay}"))
    return f.join(p, (F.col("call_id") == F.col("parent_call_id")) & near, "leftOuter").select("call_id", "raw_call_id", "call_time")


def append_stream(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append-mode Parquet sink that stops when the input is read."""
    return df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


