"""Model-call logs: redaction, profiles, health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as js
from ..functions import numbers as num
from ..functions import text as tx
from ..functions.nested import redact_payloads


def call_health(calls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals and per-function health of a call log: ``function`` is null on the total row.

    ``calls``: keys, function, record_type, status, error_category, elapsed_sec, time, call_id.
    The per-function average divides by all records, the total one only by rows with a number.
    """
    d = calls.withColumn("function", F.coalesce("function", F.lit("unknown")))
    seq = F.struct("time", "call_id")
    # Partial sums per function first; the total is the sum of these few rows.
    per = d.groupBy(*keys, "function").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("record_type") == "function_call").alias("function_calls"),
        F.count_if(F.col("record_type") == "provider_call").alias("provider_calls"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "failure").alias("failure"),
        F.coalesce(F.sum("elapsed_sec"), F.lit(0.0)).alias("elapsed_sum"),
        F.count("elapsed_sec").alias("elapsed_n"),
        F.max_by(F.struct("status", "error_category"), seq).alias("_last"),
    )
    n = F.greatest(F.lit(1), F.col("records"))
    rate = num.round_at(F.col("success") / n, 4).alias("success_rate")
    counts = ["records", "function_calls", "provider_calls", "success", "failure"]
    slots = per.select(
        *keys, "function", *counts, rate, num.round_at(F.col("elapsed_sum") / n, 3).alias("elapsed_sec_avg"),
        F.col("_last.status").alias("last_status"), F.col("_last.error_category").alias("last_error_category"),
    )
    total = per.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in [*counts, "elapsed_sum", "elapsed_n"]])
    avg = F.when(F.col("elapsed_n") > 0, num.round_at(F.col("elapsed_sum") / F.col("elapsed_n"), 3)).otherwise(0.0)
    none = F.lit(None).cast("string")
    return slots.unionByName(
        total.select(*keys, none.alias("function"), *counts, rate, avg.alias("elapsed_sec_avg"), none.alias("last_status"), none.alias("last_error_category"))
    )


def link_provider_calls(calls: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Function calls with the provider calls made under them, one row per link (null when there is none)."""
    fn = calls.where("record_type = 'function_call'").select(*keys, "call_id", "time")
    raw = calls.where("record_type = 'provider_call' and parent_call_id is not null").select(
        *keys, F.col("parent_call_id").alias("call_id"), F.col("call_id").alias("raw_call_id")
    )
    return fn.join(raw, [*keys, "call_id"], "left")


def image_inventory(requests: DataFrame, files: DataFrame, key: str = "call_id") -> DataFrame:
    """Requested image paths per call against the file catalog: counts and known bytes."""
    d = requests.select(key, "attached_count", F.posexplode_outer("images").alias("_i", "path")).join(files.select("path", "size_bytes").dropDuplicates(["path"]), "path", "left")
    return d.groupBy(key).agg(
        F.count("path").alias("requested_count"), F.max("attached_count").alias("attached_count"),
        F.count_if(F.col("path").isNotNull() & F.col("size_bytes").isNull()).alias("missing_count"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
    )


def index_rows(calls: DataFrame) -> DataFrame:
    """Call details to index rows: redacted payload, its profile, and the error category."""
    calls = redact_payloads(calls, "payload")
    p = F.col("payload")
    return calls.select(
        "call_id", "function", "record_type", "status", tx.error_category(F.col("error")).alias("error_category"),
        num.round_at(F.col("elapsed_sec"), 3).alias("elapsed_sec"), "time", p.alias("payload"),
        F.array_join(js.top_level_keys(p), ",").alias("top_level_keys"), F.octet_length(js.canonical(p)).alias("payload_bytes"),
    )


def last_status(calls: DataFrame, keys: Sequence[str] = ("function",)) -> DataFrame:
    """Status of the latest call of each key (time, then call_id), null or not: keys, last_status."""
    last = F.max_by(F.struct("status"), F.struct("time", "call_id"))
    return calls.groupBy(*keys).agg(last.alias("_s")).select(*keys, F.col("_s.status").alias("last_status"))


def usage_fields(responses: DataFrame, response: str = "response") -> DataFrame:
    """Adds ``usage`` (JSON text of the response's usage object), its token counts, and ``finish_reason`` of the first choice.

    Both come only from a response that is a JSON object; the choice must be an object in a list. Text that does not
    parse, null and missing fields give null.
    """
    kept = responses.withColumn("_v", F.try_parse_json(response))
    usage = F.try_variant_get("_v", "$.usage", "variant")
    count = lambda name: F.try_variant_get("_v", f"$.usage.{name}", "bigint").alias(name)
    return kept.select(
        *[c for c in responses.columns], F.when(~F.is_variant_null(usage), F.to_json(usage)).alias("usage"), count("prompt_tokens"), count("completion_tokens"),
        count("total_tokens"), F.try_variant_get("_v", "$.choices[0].finish_reason", "string").alias("finish_reason"),
    )
