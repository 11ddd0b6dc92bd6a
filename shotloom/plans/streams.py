"""Queries that write the driver tables as files and read them back, as streams or artifacts."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import staging
from ..operators import subtitles as sub
from ..sources import artifacts as ar
from ..streaming import calls as sc
from ..streaming import stages as ss
from . import oracle as o
from . import views as v
from .assembly import CALL_ROWS, call_rows
from .registry import query, typed


def folder(df) -> str:
    """New folder below the shared one."""
    return f"{staging.staging_dir(df.sparkSession)}/files-{uuid.uuid4().hex}"


def call_log(spark, d):
    """The call log as line-JSON files."""
    c = call_rows(spark, d)
    rows = c.select(
        F.lpad(F.col("call_id").cast("string"), 12, "0").alias("call_id"),
        F.when(F.col("record_type") == "provider_call", F.lpad((F.col("call_id") + 1).cast("string"), 12, "0")).alias("parent_call_id"),
        "record_type", "function", "status", "error", "error_category", "elapsed_sec", F.timestamp_micros((F.col("time") * 1e6).cast("bigint")).alias("time"), "payload",
    )
    path = folder(rows)
    rows.repartitionByRange("time").write.json(path)
    return path


def ended_log(spark, d):
    """The call log with a heartbeat beyond all delays at its end."""
    path = call_log(spark, d)
    last = spark.read.schema("time timestamp").json(path).agg(F.max("time")).first()[0]
    if last is not None:
        sc.write_heartbeat(spark, path, last + timedelta(days=1))
    return path


HEALTH_COLS = """SELECT function, count(*) AS records, count(*) FILTER (record_type = 'function_call') AS function_calls, count(*) FILTER (record_type = 'provider_call') AS provider_calls,
    count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failure') AS failure, arg_max(status, call_id) AS last_status FROM c GROUP BY function"""


@query("stream_call_health", o.with_views("v_calls", f", {CALL_ROWS} {HEALTH_COLS}"))
def _(spark, d):
    path = call_log(spark, d)
    sc.stream_call_health(sc.read_calls(spark, path, 1), f"{path}-out", f"{path}-chk").awaitTermination()
    return sc.call_health_table(spark, f"{path}-out").select("function", "records", "function_calls", "provider_calls", "success", "failure", "last_status")


@query("stream_call_index", o.with_views("v_calls", f", {CALL_ROWS} SELECT function, category AS error_category, count(*) AS rows FROM c GROUP BY ALL"))
def _(spark, d):
    path = call_log(spark, d)
    sc.stream_call_index(sc.read_calls(spark, path, 2), f"{path}-out", f"{path}-chk").awaitTermination()
    return spark.read.parquet(f"{path}-out").groupBy("function", "error_category").agg(F.count(F.lit(1)).alias("rows"))


@query("stream_errors", o.with_views("v_calls", """
  , e AS (SELECT time_bucket(INTERVAL 1 HOUR, make_timestamp(CAST(time * 1e6 AS BIGINT))) AS w, make_timestamp(CAST(time * 1e6 AS BIGINT)) AS t, function AS stage,
     CASE WHEN error = 'Connection reset by peer' THEN 'network' ELSE 'timeout' END AS category FROM v_calls WHERE error IS NOT NULL)
  SELECT CAST(epoch(w) AS BIGINT) AS window_start, stage, category, count(*) AS errors FROM e GROUP BY ALL"""))
def _(spark, d):
    """One micro-batch, so nothing is late; the heartbeat closes the last windows."""
    path = ended_log(spark, d)
    sc.append_stream(sc.stream_errors(sc.read_calls(spark, path)), f"{path}-out", f"{path}-chk").awaitTermination()
    return spark.read.parquet(f"{path}-out").withColumn("window_start", F.unix_seconds("window_start"))


@query("stream_link_calls", o.with_views("v_calls", """
  , f AS (SELECT lpad(CAST(call_id AS VARCHAR), 12, '0') AS id, CAST(time * 1e6 AS BIGINT) // 1000 AS t, call_id FROM v_calls WHERE record_type = 'function_call'),
  p AS (SELECT call_id + 1 AS parent, lpad(CAST(call_id AS VARCHAR), 12, '0') AS raw, CAST(time * 1e6 AS BIGINT) // 1000 AS t FROM v_calls WHERE record_type = 'provider_call')
  SELECT f.id AS call_id, p.raw AS raw_call_id, f.t AS call_time FROM f LEFT JOIN p ON p.parent = f.call_id AND abs(p.t - f.t) <= 3600000"""))
def _(spark, d):
    path = ended_log(spark, d)
    linked = sc.stream_link_calls(sc.read_calls(spark, path), sc.read_calls(spark, path))
    sc.append_stream(linked, f"{path}-out", f"{path}-chk").awaitTermination()
    return spark.read.parquet(f"{path}-out").withColumn("call_time", F.unix_millis("call_time"))


@query("stream_stage_state", """
  WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'running' END AS status,
     CASE WHEN event_type = 'error' THEN 'boom ' || event_id END AS error FROM events)
  SELECT CAST(user_id AS VARCHAR) AS video_id, 'all' AS stage, arg_max(status, event_id) AS status,
    CASE WHEN max(event_id) FILTER (error IS NOT NULL) > coalesce(max(event_id) FILTER (status IN ('running', 'done')), -1) THEN arg_max(error, event_id) END AS error,
    coalesce(max(event_id) FILTER (status IN ('done', 'failed', 'skipped')), -1) > coalesce(max(event_id) FILTER (status = 'running'), -1) AS finished FROM e GROUP BY user_id""")
def _(spark, d):
    e = v.events(spark, d)
    status = F.when(F.col("event_type") == "click", "done").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped").otherwise("running")
    rows = e.select(
        F.col("user_id").cast("string").alias("video_id"), F.lit("all").alias("stage"), status.alias("status"), F.col("ts").cast("timestamp").alias("time"),
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", F.concat(F.lit("boom "), "event_id")).alias("error"),
    )
    path = folder(rows)
    rows.write.json(path)
    ss.stream_stage_state(ss.read_stage_events(spark, path), f"{path}-out", f"{path}-chk").awaitTermination()
    got = ss.latest_state(spark, f"{path}-out")
    return got.select("video_id", "stage", "status", "error", F.col("finished_at").isNotNull().alias("finished"))


# --- files -----------------------------------------------------------------------------


@query("read_artifacts", """
  SELECT CAST(s_nationkey AS VARCHAR) AS video_id, s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier""")
def _(spark, d):
    s = v.table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))
    one = s.groupBy("s_nationkey").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(F.to_json(F.struct("s_suppkey", "s_name", "s_acctbal"))), ",\n  "), F.lit("]")).alias("value"))
    path = folder(one)
    one.write.partitionBy("s_nationkey").text(path)
    got = ar.read_artifacts(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")
    return got.select(F.element_at(F.split("video_id", "="), -1).alias("video_id"), "s_suppkey", "s_name", "s_acctbal")


def clip_millis():
    """Whole milliseconds since the first day, without floating point."""
    return F.unix_millis(F.col("ts").cast("timestamp")) - 1704067200000


def utterances(spark, d):
    start = clip_millis()
    text = F.when(F.col("event_type") == "error", " ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))
    return v.events(spark, d).select(
        F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("seq"), start.alias("start_time"), (start + F.floor("value") * 1000).alias("end_time"), text.alias("text")
    )


UTTERANCES = "u AS (SELECT CAST(user_id AS VARCHAR) AS video_id, event_id, (epoch_us(ts) // 1000 - 1704067200000) AS s, floor(value) AS secs, event_type FROM events)"


@query("export_json_files", f"""
  WITH {UTTERANCES} SELECT video_id, event_id AS index, CAST(s AS BIGINT) AS start_ms, CAST(s + secs * 1000 AS BIGINT) AS end_ms, event_type AS text FROM u WHERE event_type <> 'error'""")
def _(spark, d):
    u = utterances(spark, d)
    path = folder(u)
    ar.export_segments(u, path, "json")
    return spark.read.schema("video_id string, index bigint, start_ms bigint, end_ms bigint, text string").json(path).drop("bucket")


@query("export_raw_json_files", f"""
  WITH {UTTERANCES} SELECT video_id, event_id AS seq, CAST(s AS BIGINT) AS start_time, CASE WHEN event_type = 'error' THEN ' ' ELSE ' ' || event_type || ' ' END AS text FROM u""")
def _(spark, d):
    u = utterances(spark, d)
    path = folder(u)
    ar.export_segments(u, path, "raw-json")
    return spark.read.schema("video_id string, seq bigint, start_time bigint, text string").json(path).drop("bucket")


@query("export_txt_files", f"""
  WITH {UTTERANCES} SELECT video_id, event_type AS line, count(*) AS lines FROM u WHERE event_type <> 'error' GROUP BY ALL""")
def _(spark, d):
    u = utterances(spark, d)
    path = folder(u)
    ar.export_segments(u, path, "txt")
    return spark.read.text(path).where(F.trim("value") != "").groupBy(F.col("video_id").cast("string").alias("video_id"), F.trim("value").alias("line")).agg(F.count(F.lit(1)).alias("lines"))


@query("append_log", "SELECT event_type AS event, count(*) AS rows FROM events GROUP BY event_type")
def _(spark, d):
    e = v.events(spark, d).select(F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("event"), "props")
    path = folder(e)
    ar.append_log(e.where("event in ('view', 'click')"), path)
    ar.append_log(e.where("event not in ('view', 'click')"), path)
    return spark.read.schema("time timestamp, event string, props string").json(path).groupBy("event").agg(F.count(F.lit(1)).alias("rows"))


@query("read_jsonl", "SELECT user_id, count(*) AS rows, count(*) FILTER (event_type = 'error') AS corrupt FROM events GROUP BY user_id")
def _(spark, d):
    from pyspark.sql.types import StringType, StructType

    line = F.when(F.col("event_type") == "error", F.concat(F.lit('{"user_id":"'), F.col("user_id"), F.lit('" oops'))).otherwise(F.to_json(F.struct(F.col("user_id").cast("string").alias("user_id"), "event_type")))
    e = v.events(spark, d).select("user_id", line.alias("value"))
    path = folder(e)
    e.select("value").write.text(path)
    got = ar.read_jsonl(spark, path, StructType().add("user_id", StringType()).add("event_type", StringType()), strict=False)
    got = got.select("user_id", "_corrupt_record")
    uid = F.coalesce("user_id", F.regexp_extract("_corrupt_record", r'user_id":"(\d+)', 1)).cast("bigint")
    return got.withColumn("user_id", uid).groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.count("_corrupt_record").alias("corrupt"))


@query("write_artifacts", typed("""SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS low FROM orders GROUP BY o_custkey""", bigint="low"))
def _(spark, d):
    rows = ar.hashed(v.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), 8, "o_custkey")
    path = folder(rows)
    ar.write_artifacts(rows.withColumn("o_orderpriority", F.when(F.col("bucket") < 4, "stale").otherwise(F.col("o_orderpriority"))), path)
    ar.write_artifacts(rows.where("bucket < 4"), path)
    return spark.read.parquet(path).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"))


@query("export_srt_files", """
  SELECT CAST(user_id AS VARCHAR) AS video_id, count(*) AS cues, min(event_type) AS first_text FROM events WHERE value >= 1 GROUP BY user_id""")
def _(spark, d):
    start = clip_millis()
    e = v.events(spark, d).select(
        F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("seq"), start.alias("start_time"), (start + F.floor("value") * 1000).alias("end_time"), F.col("event_type").alias("text")
    )
    path = folder(e)
    ar.export_segments(e, path, "srt")
    files = spark.read.text(path, wholetext=True).select(F.col("video_id").cast("string").alias("video_id"), F.concat("value", F.lit("\n")).alias("content"))
    return sub.parse_srt(files).groupBy("video_id").agg(F.count(F.lit(1)).alias("cues"), F.min("text").alias("first_text"))


@query("catalog_files")
def _(spark, d):
    return ar.catalog_files(spark, d, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "video_id", "size_bytes", "sha256")


@query("discover_artifacts", "SELECT count(*) AS lines, count(*) FILTER (event_type = 'error') AS bad FROM events")
def _(spark, d):
    from ..functions.jsontext import json_valid

    line = F.when(F.col("event_type") == "error", F.lit("{oops")).otherwise(F.col("props"))
    e = v.events(spark, d).select(line.alias("value"))
    path = folder(e)
    e.write.text(path)
    got = ar.discover_lines(spark, path, line_files="*.txt")
    return got.agg(F.count(F.lit(1)).alias("lines"), F.count_if(~json_valid(F.col("line"))).alias("bad"))


@query("read_ocr_results", "SELECT count(*) AS pages, count(DISTINCT text) AS texts FROM conversations")
def _(spark, d):
    c = v.table(spark, d, "conversations")
    item = F.create_map(F.lit("prunedResult"), F.col("text"))
    r = c.groupBy("conv_id").agg(F.collect_list(item).alias("ocrResults")).select(
        F.to_json(F.struct(F.struct(F.create_map(F.lit("conv"), F.col("conv_id").cast("string")).alias("dataInfo"), "ocrResults").alias("result"))).alias("value")
    )
    path = folder(r)
    r.write.text(path)
    pages, _ = ar.read_ocr_results(spark, path)
    return pages.agg(F.count(F.lit(1)).alias("pages"), F.count_distinct(F.col("item")["prunedResult"]).alias("texts"))
