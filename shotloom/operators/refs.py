"""Keyed table logic: expected against actual, upserts, ordered references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = ["video_id"]


def difference(expected: DataFrame, produced: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected keys that were not produced."""
    return expected.select(*on).distinct().join(produced.select(*on), list(on), "left_anti")


def intersect(rows: DataFrame, valid: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is valid."""
    return rows.join(valid.select(*on), list(on), "left_semi")


def expected_vs_actual(expected: DataFrame, outputs: DataFrame, on: Sequence[str], order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, unexpected, missing): the last output of an expected key wins.

    Expected keys are shuffled before they are made distinct, into as many partitions as the session shuffles into, so that
    no task holds the distinct keys of a whole input split.
    """
    wanted = expected.select(*on).repartition(int(expected.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on).distinct()
    last = outputs.groupBy(*on).agg(F.max_by(F.struct(*outputs.columns), order).alias("_r")).select("_r.*")
    kept = last.join(wanted, list(on), "left_semi")
    unexpected = outputs.join(wanted, list(on), "left_anti")
    return kept, unexpected, difference(wanted, outputs, on)


def upsert(base: DataFrame, delta: DataFrame, on: Sequence[str]) -> DataFrame:
    """Replace the rows of the keys in ``delta``, keep the others."""
    return base.join(delta.select(*on).distinct(), list(on), "left_anti").unionByName(delta)


def ordered_refs(refs: DataFrame, order: DataFrame, parents: Sequence[str], ref: str = "shot_id") -> DataFrame:
    """Distinct references in the parent's order, unknown ones last by name; adds ``sort_ord`` and ``known``."""
    got = refs.select(*parents, ref).distinct().join(order.select(*parents, ref, F.col("ord").alias("_o")), [*parents, ref], "left")
    return got.select(*parents, ref, F.col("_o").isNotNull().alias("known"), F.coalesce("_o", F.lit(2**31 - 1)).alias("sort_ord"))


def ordered_union(first: Column, second: Column) -> Column:
    """References of the first list, then the new ones of the second."""
    return F.array_distinct(F.filter(F.concat(first, second), lambda x: x.isNotNull() & (x != "")))


def frame_candidates(cards: DataFrame, refs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames of a chapter's cards: referenced cards first, the recommended frame before the others.

    ``cards``: keys, shot_id, ord, recommended, frames. ``refs``: keys, shot_id, ref_ord.
    Returns keys, frame, place (ordering struct).
    """
    d = cards.join(refs.select(*keys, "shot_id", "ref_ord"), [*keys, "shot_id"], "left")
    place = F.struct(F.col("ref_ord").isNull().alias("late"), F.coalesce("ref_ord", "ord").alias("o"))
    all_ = F.filter(F.concat(F.array(F.trim("recommended")), F.transform("frames", lambda f: F.trim(f))), lambda x: x.isNotNull() & (x != ""))
    flat = d.select(*keys, place.alias("_p"), F.posexplode(all_).alias("_i", "frame"))
    return flat.groupBy(*keys, "frame").agg(F.min(F.struct("_p.late", "_p.o", "_i")).alias("place"))


def select_frame(candidates: DataFrame, preferred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First preferred frame that is a candidate, else the first candidate. ``preferred``: keys, frame, pref_ord."""
    d = candidates.join(preferred.select(*keys, "frame", "pref_ord"), [*keys, "frame"], "left")
    return d.groupBy(*keys).agg(F.min_by("frame", F.struct(F.col("pref_ord").isNull(), "pref_ord", "place")).alias("frame"))


def first_existing(candidates: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First candidate, in order, that exists. ``candidates``: keys, path, shot_ord, cand_ord."""
    live = candidates.join(files.select("path").distinct(), "path", "left_semi")
    return live.groupBy(*keys).agg(F.min_by("path", F.struct("shot_ord", "cand_ord")).alias("path"))


def prefer_new_layout(new: DataFrame, legacy: DataFrame, on: Sequence[str]) -> DataFrame:
    """Artifacts of the new layout, and legacy ones only where no new one exists."""
    old = legacy.join(new.select(*on), list(on), "left_anti")
    return new.withColumn("layout", F.lit("new")).unionByName(old.withColumn("layout", F.lit("legacy")))


def content_key(text: Column, kind: str, hash_: str = "sha256") -> Column:
    """``kind-hash`` of a content; ``crc32`` gives the short form, which can collide on a large library."""
    digest = F.sha2(text, 256) if hash_ == "sha256" else F.lpad(F.lower(F.hex(F.crc32(text))), 8, "0")
    return F.concat(F.lit(f"{kind}-"), digest)


def pending_inference(inputs: DataFrame, cache: DataFrame, text: str, kind: str, hash_: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """(reused, pending): identical content is pending once.

    ``cache``: cache_key, result; a null result counts as malformed and is not reused; of several good
    results of one key the largest is.
    """
    keyed = inputs.withColumn("cache_key", content_key(F.col(text), kind, hash_))
    good = cache.where(F.col("result").isNotNull()).groupBy("cache_key").agg(F.max("result").alias("result"))
    reused = keyed.join(good, "cache_key")
    todo = keyed.join(good.select("cache_key"), "cache_key", "left_anti")
    return reused, todo.groupBy("cache_key").agg(F.min(text).alias(text), F.count(F.lit(1)).alias("n_inputs"))


def canonical_path(rows: DataFrame, layout: DataFrame, path: str = "path") -> DataFrame:
    """Replace the first folder of a path by its current name. ``layout``: folder, stage_dir (the fixed stage table)."""
    head, tail = F.substring_index(path, "/", 1), F.expr(f"substring({path}, locate('/', {path}) + 1)")
    d = rows.withColumn("folder", F.when(F.col(path).contains("/"), head))
    return d.join(layout.select("folder", "stage_dir").distinct(), "folder", "left").withColumn(
        path, F.when(F.col("stage_dir").isNotNull(), F.concat("stage_dir", F.lit("/"), tail)).otherwise(F.col(path))
    ).drop("folder", "stage_dir")
