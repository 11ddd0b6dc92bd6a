"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm.common import in_slots, lookup, slot_of
from shotloom.operators.staging import materialize

#: Bytes at the start of a text that the second step looks at.
PREFIX_BYTES = 64


def _repeated_slots(df: DataFrame, *keys: str) -> DataFrame:
    """Slots of the keys that occur more than once; counts are combined before the shuffle."""
    many = df.groupBy(*keys).count().filter(F.col("count") > 1)
    return materialize(many.select(slot_of(*keys).alias("slot")).distinct())


def _refined(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Slots of repeated lengths and of repeated (length, prefix) pairs. Each pass shuffles keys and counts only."""
    sized = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_len", F.octet_length("_text"))
    lengths = _repeated_slots(sized.select("_len"), "_len")
    some = in_slots(sized, lengths, slot_of("_len")).select("_len", F.xxhash64(F.encode("_text", "UTF-8").substr(1, PREFIX_BYTES)).alias("_prefix"))
    return lengths, _repeated_slots(some, "_len", "_prefix")


def _candidate(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows with `_text`, `_len` and `_maybe`: whether length and prefix both recur, so that the full text must be read."""
    lengths, prefixes = _refined(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_text", text).withColumn("_len", F.octet_length("_text"))
    by_len = F.broadcast(lengths.select(F.col("slot").alias("_len_slot")))
    by_prefix = F.broadcast(prefixes.select(F.col("slot").alias("_prefix_slot")))
    df = df.join(by_len, slot_of("_len") == F.col("_len_slot"), "left")
    prefix = F.when(F.col("_len_slot").isNotNull(), F.xxhash64(F.encode("_text", "UTF-8").substr(1, PREFIX_BYTES)))
    df = df.withColumn("_prefix", prefix).join(by_prefix, slot_of("_len", "_prefix") == F.col("_prefix_slot"), "left")
    return df.withColumn("_maybe", F.col("_len_slot").isNotNull() & F.col("_prefix_slot").isNotNull()).drop("_len_slot", "_prefix_slot", "_prefix")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: `id_col`, keep_id, group_size, kept, text_sha256, n_bytes.

    Lengths are counted first; among rows of a repeated length, (length, prefix hash) pairs are counted; only rows that
    still share both are hashed in full and grouped. `text_sha256` is null for rows decided before that, unless
    `digest_all` asks for the digest as an output. The two refinement filters are bounded broadcasts of slots, so texts
    are never shuffled; rows that share a slot by chance are told apart by length and full hash.

    The row with the largest id of a group stays. A null text counts as empty, and all empty texts are one group. A null
    id is smaller than any other; rows with equal id and equal text are one group of which exactly one row is kept. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    df = _candidate(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_raw")), "_raw")
    full = F.sha2(F.col("_text"), 256)
    rows = materialize(df.select(
        "_id", "_len", "_maybe", F.monotonically_increasing_id().alias("_row"), (full if digest_all else F.when(F.col("_maybe"), full)).alias("_sha"),
    ))
    some = rows.filter("_maybe").withColumn("_key", F.concat_ws(":", "_len", "_sha"))
    best = F.max(F.struct(F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = some.groupBy("_key").agg(best.alias("_best"), F.count("*").alias("group_size"))
    found = lookup(some, materialize(groups.filter("group_size > 1")), "_key", "group_size", "left")
    done = found.select(
        "_id", F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("_best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"), (F.col("group_size").isNull() | (F.col("_best.row") == F.col("_row"))).alias("kept"), "_sha", "_len",
    )
    alone = rows.filter("NOT _maybe").select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "_sha", "_len")
    both = done.unionByName(alone)
    return both.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"), F.col("_len").cast("long").alias("n_bytes"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows without copies, all columns kept; of equal texts the row with the largest id stays.

    Rows whose length or prefix is unique pass through in place. Only the others are shuffled, by full hash, with one row
    per hash leaving each task. Nulls, ties and repeated rows as in `exact_dedup`; columns must be orderable.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.col(id_col).alias("_id"), F.col(text_col).alias("_raw"))
    df = _candidate(own, "_raw")
    some = df.filter("_maybe").select("_id", "_all", F.concat_ws(":", "_len", F.sha2("_text", 256)).alias("_key"))
    best = some.groupBy("_key").agg(F.max(F.struct("_id", "_all")).alias("_best")).select(F.col("_best._all").alias("_all"))
    return df.filter("NOT _maybe").select("_all").unionByName(best).select("_all.*")
