"""Run state per (video, stage) from a stream of stage events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .folded import fold_in, folded

EVENT_SCHEMA = "video_id string, stage string, status string, time timestamp, seq bigint, error string"
KEYS = ["video_id", "stage"]


def read_stage_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(EVENT_SCHEMA)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).json(path)


def partial_states(events: DataFrame) -> DataFrame:
    """What the events say about each (video, stage), in a form that merges in any order; events without a time are left out."""
    at = F.struct("time", "seq")

    def last(cond: Column, value: Column) -> Column:
        return F.max(F.when(cond, F.struct(F.col("time").alias("t"), F.col("seq").alias("s"), value.alias("v"))))

    s = F.col("status")
    return events.where("time is not null").groupBy(*KEYS).agg(
        F.max(F.struct("time", "seq", "status")).alias("_now"),
        F.max(F.when(s == "running", at)).alias("_run"),
        F.max(F.when(s.isin("done", "failed", "skipped"), at)).alias("_end"),
        F.max(F.when(s.isin("running", "done") & F.col("error").isNull(), at)).alias("_clear"),
        last(F.col("error").isNotNull(), F.col("error")).alias("_err"),
    )


def merge_states(parts: DataFrame) -> DataFrame:
    """Partial states of a key as one: the latest of each kind of event."""
    return parts.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in ("_now", "_run", "_end", "_clear", "_err")])


def state_view(states: DataFrame) -> DataFrame:
    never = F.col("_run").isNull()
    end_ok = F.col("_end").isNotNull() & (never | (F.col("_end") > F.col("_run")))
    err_at = F.struct(F.col("_err.t").alias("time"), F.col("_err.s").alias("seq"))
    err_ok = F.col("_err").isNotNull() & (F.col("_clear").isNull() | (err_at > F.col("_clear")))
    return states.select(
        *KEYS, F.col("_now.status").alias("status"), F.col("_run.time").alias("started_at"),
        F.when(end_ok, F.col("_end.time")).alias("finished_at"), F.when(err_ok, F.col("_err.v")).alias("error"),
    )


def stage_state(events: DataFrame) -> DataFrame:
    """Latest state per (video, stage).

    Rules: ``running`` sets the start and clears finish and error; ``done``, ``failed`` and ``skipped`` set the
    finish; ``done`` clears the error. So: start = last running; finish and error count only after that start.
    """
    return state_view(partial_states(events))


def stream_stage_state(events: DataFrame, out: str, checkpoint: str, once: bool = True, every: int = 10) -> StreamingQuery:
    """Keep run state current. Each trigger adds what its own events say; ``latest_state`` reads the parts as one.

    The answer is that of ``stage_state`` over all events, whatever their order and lateness. The stream keeps no state; finished keys
    cost their row in the table, which is merged every few triggers.
    """

    def write(batch: DataFrame, version: int) -> None:
        fold_in(partial_states(batch), out, version, merge_states, every)

    w = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def latest_state(spark: SparkSession, out: str) -> DataFrame:
    return state_view(folded(spark, out, merge_states))
