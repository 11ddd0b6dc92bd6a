"""Staleness of stage results and the dependency order behind it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import materialize


def stale_partitions(wanted: DataFrame, manifests: DataFrame, edges: DataFrame, signatures: DataFrame) -> DataFrame:
    """(video_id, stage, reason) of results that must be rebuilt.

    ``wanted``: video_id, stage. ``manifests``: video_id, stage, status, mtime, signature. ``edges``: stage,
    depends_on (the fixed stage graph). ``signatures``: stage, signature that is current (absent stages have none).
    Only direct dependencies count: a missing or newer one makes a result stale.
    """
    keys = ["video_id", "stage"]
    have = wanted.join(manifests.select(*keys, "status", "mtime", "signature"), keys, "left")
    deps = manifests.select("video_id", F.col("stage").alias("depends_on"), F.col("mtime").alias("_dep"))
    late = (
        have.select(*keys, "mtime").join(edges, "stage").join(deps, ["video_id", "depends_on"], "left")
        .groupBy(*keys).agg(F.bool_or(F.col("_dep").isNull() | (F.col("_dep") > F.col("mtime"))).alias("_late"))
    )
    d = have.join(late, keys, "left").join(signatures.withColumnRenamed("signature", "_want"), "stage", "left")
    reason = (
        F.when(F.col("mtime").isNull(), "missing")
        .when(F.col("status") != "done", "not_done")
        .when(F.col("_want").isNotNull() & (F.coalesce("signature", F.lit("")) != F.col("_want")), "signature_changed")
        .when(F.coalesce("_late", F.lit(False)), "dependency_newer")
    )
    return d.select(*keys, reason.alias("reason")).where("reason is not null")


def upstream_closure(edges: DataFrame) -> DataFrame:
    """All (node, upstream) pairs of an acyclic graph with the longest distance as ``depth`` (a build order).

    Path doubling: a round knows the pairs joined by fewer than 2^k steps and those joined by exactly 2^k, and puts them
    together, so a chain takes log2 rounds of equality joins, each written. A cycle is an error that names some of its nodes.
    """
    exact = materialize(edges.select("node", F.col("depends_on").alias("upstream")).where("node IS NOT NULL AND upstream IS NOT NULL").distinct())
    known, steps = None, 1
    while exact.take(1):
        jump = exact.select(F.col("node").alias("upstream"), F.col("upstream").alias("_to"))
        found = exact.select("node", "upstream", F.lit(steps).alias("depth"))
        if known is not None:
            longer = known.join(jump, "upstream").select("node", F.col("_to").alias("upstream"), (F.col("depth") + steps).alias("depth"))
            found = known.unionByName(found).unionByName(longer)
        known = materialize(found.groupBy("node", "upstream").agg(F.max("depth").alias("depth")))
        loop = [r[0] for r in known.where("node = upstream").select("node").orderBy("node").limit(5).collect()]
        if loop:
            raise ValueError(f"the dependencies hold a cycle through {', '.join(map(str, loop))}")
        exact = materialize(exact.join(jump, "upstream").select("node", F.col("_to").alias("upstream")).distinct())
        steps *= 2
    return known if known is not None else exact.select("node", "upstream", F.lit(0).alias("depth"))
