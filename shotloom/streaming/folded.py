"""Tables that grow by one small part per trigger and are read as one fold.

A trigger writes the partial aggregates of its rows only, under its own number, so a replayed trigger rewrites the same folder
and nothing else. Partial aggregates of a key merge in any order, so no state has to be kept in the stream, and late rows count like all
others. Every few triggers the finished parts are merged into a base; a reader takes the newest complete base and the parts after it.

    out/part/version=N    partial aggregates of trigger N
    out/base/upto=M       the merge of all parts up to M
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Merge = Callable[[DataFrame], DataFrame]


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the complete sub-folders ``name=N``."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at)]
    done = [p for p in found if p.getName().startswith(f"{name}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _remove(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _parts(spark: SparkSession, out: str, upto: int | None = None) -> list[str]:
    bases = _numbers(spark, f"{out}/base", "upto")
    last = bases[-1] if bases else -1
    versions = [n for n in _numbers(spark, f"{out}/part", "version") if n > last and (upto is None or n <= upto)]
    return [f"{out}/base/upto={last}"] * bool(bases) + [f"{out}/part/version={n}" for n in versions]


def fold_in(part: DataFrame, out: str, version: int, merge: Merge, every: int = 10) -> None:
    """Write the part of a trigger. With `every` parts since the last base, a new base is written first, from the triggers before.

    The base before the newest one stays for running readers, with the parts that it lacks; all older folders go.
    """
    spark = part.sparkSession
    part.write.mode("overwrite").parquet(f"{out}/part/version={version}")
    older = [n for n in _numbers(spark, f"{out}/part", "version") if n < version]
    bases = _numbers(spark, f"{out}/base", "upto")
    fresh = [n for n in older if not bases or n > bases[-1]]
    if len(fresh) < every:
        return
    merge(spark.read.parquet(*_parts(spark, out, upto=fresh[-1]))).write.mode("overwrite").parquet(f"{out}/base/upto={fresh[-1]}")
    if bases:
        for n in older:
            if n <= bases[-1]:
                _remove(spark, f"{out}/part/version={n}")
        for n in bases[:-1]:
            _remove(spark, f"{out}/base/upto={n}")


def folded(spark: SparkSession, out: str, merge: Merge) -> DataFrame:
    """Everything that was folded in so far: one row per key."""
    return merge(spark.read.parquet(*_parts(spark, out)))
