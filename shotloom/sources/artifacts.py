"""Reading and writing of artifact tables: JSON, line JSON, text, logs, catalogs."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from itertools import chain, groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship

CORRUPT = "_corrupt_record"
#: Files up to this many bytes are hashed as one value; larger ones are read in slices of SLICE bytes.
WHOLE_FILE, SLICE = 64 << 20, 8 << 20


def project_id(depth: int = 1) -> Column:
    """Folder name ``depth`` levels above the file: the video a file belongs to."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - depth)


def read_artifacts(spark: SparkSession, path: str, schema: StructType | str, depth: int = 1) -> DataFrame:
    """Whole-file JSON objects with ``video_id`` taken from the folder."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("video_id", project_id(depth))


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = True, depth: int = 1) -> DataFrame:
    """Line JSON. Strict mode fails on a bad line; otherwise it is kept in ``_corrupt_record``. Blank lines are skipped.

    Strict mode looks through the files once before they are read, so that its error names the file and the line.
    """
    reader = spark.read
    if strict:
        first = _placed(spark, path, schema).where("_bad is not null").select("path", (F.col("_before") + F.col("_bad") + 1).alias("line_no")).orderBy("path", "line_no").first()
        if first:
            raise ValueError(f"Invalid JSON in {first['path']}:{first['line_no']}")
        df = reader.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        wide = StructType([*schema.fields]).add(CORRUPT, "string")
        df = reader.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return df.withColumn("video_id", project_id(depth))


def _lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Lines with their file, the start of their split, a number that counts up within it, and whether they are bad JSON."""
    wide = StructType([*schema.fields]).add(CORRUPT, "string")
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    d = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value",
    )
    return d.withColumn("_wrong", (F.trim("value") != "") & parsed[CORRUPT].isNotNull())


def _placed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One row per file split: its first number, the lines before it in its file, and where its first bad line is."""
    splits = _lines(spark, path, schema).groupBy("path", "_at").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"), (F.min(F.when(F.col("_wrong"), F.col("_id"))) - F.min("_id")).alias("_bad"),
    )
    return splits.withColumn("_before", F.sum("_n").over(Window.partitionBy("path").orderBy("_at")) - F.col("_n"))


def jsonl_errors(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Every bad line of line-JSON files: path, line_no (from 1, blank lines counted), line.

    Splits count their lines where they are read; line numbers come from a running sum over the splits of a file.
    """
    bad = _lines(spark, path, schema).where("_wrong")
    splits = _placed(spark, path, schema).select("path", "_at", "_first", "_before")
    return bad.join(splits, ["path", "_at"]).select("path", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), F.col("value").alias("line"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.srt") -> DataFrame:
    """Whole text files below ``path``: video_id (file stem) and content."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return d.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("video_id"), F.col("value").alias("content"))


def catalog_files(spark: SparkSession, path: str, pattern: str = "*", depth: int = 1, content_hash: bool = True) -> DataFrame:
    """Inventory of files: path, video_id, size, modification time and, if asked for, the content's SHA-256.

    Without ``content_hash`` no file is opened. Files of more than WHOLE_FILE bytes are hashed slice by slice, through the
    file system of their path (a local or mounted folder, or one that ``pyarrow.fs`` reaches), in constant memory.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    folder = F.element_at(F.split("path", "/"), -1 - depth)
    cols = ["path", folder.alias("video_id"), F.col("length").alias("size_bytes"), "modificationTime"]
    if not content_hash:
        return d.select(*cols)
    ship(spark)
    large = d.where(F.col("length") > WHOLE_FILE).select(*cols)
    hashed_large = large.repartition("path").mapInPandas(_sliced_hashes, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in large.schema)}, sha256 string")
    return d.where(F.col("length") <= WHOLE_FILE).select(*cols, F.sha2("content", 256).alias("sha256")).unionByName(hashed_large)


def _sliced_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for b in batches:
        found = []
        for path in b["path"]:
            scheme, rest = path.split(":", 1) if ":/" in path else ("file", path)
            if scheme == "file":
                system, name = fs.LocalFileSystem(), "/" + rest.lstrip("/")
            else:  # only the store is taken as a URI: Spark's paths are not escaped
                store, _, inside = rest.removeprefix("//").partition("/")
                system, top = fs.FileSystem.from_uri(f"{scheme}://{store}/")
                name = f"{top.rstrip('/')}/{inside}"
            digest = hashlib.sha256()
            with system.open_input_stream(name) as f:
                while part := f.read(SLICE):
                    digest.update(part)
            found.append(digest.hexdigest())
        yield b.assign(sha256=found)


def discover_lines(spark: SparkSession, path: str, whole_files: str = "*.json", line_files: str = "*.jsonl") -> DataFrame:
    """Lines of all JSON and line-JSON files below a folder: path, line (a whole ``.json`` file is one line)."""
    def part(pattern: str, whole: bool) -> DataFrame:
        d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=whole)
        return d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))

    return part(whole_files, True).unionByName(part(line_files, False)).where(F.trim("line") != "")


def hashed(df: DataFrame, buckets: int | None = None, key: str = "video_id") -> DataFrame:
    """Adds the write bucket of a key, so a million videos do not become a million folders; as many as the session shuffles into by default."""
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def write_artifacts(df: DataFrame, path: str, partition: str = "bucket") -> None:
    """Replace only the partitions present in ``df``; the committer makes the swap atomic per partition."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows as line JSON."""
    df.write.mode("append").json(path)


def write_lines(df: DataFrame, path: str, order: Sequence[str], line: str, key: str = "video_id", per_file: int = 0) -> None:
    """Text lines in order, in folders per video. Range partitions, as many as the session shuffles into, split a large video over several files.

    In a local or mounted folder the tasks write the files themselves, since there Spark's writer takes some 28 ms of a core
    for each file and its commit moves the files of all videos one by one on the driver. Other stores, and overwriting by
    partition, go through Spark's writer. Either way the folder is emptied first and gets its ``_SUCCESS`` last.
    """
    spark = df.sparkSession
    d = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    target = _local_folder(spark, path) if spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static" else None
    if target is None:
        rows = d.select(key, line)
    else:
        ship(spark)
        rows = d.select(F.col(key).cast("string"), F.col(line).cast("string").cast("binary")).mapInArrow(_file_writer(target, key, per_file), f"`{key}` string, value string")
    writer = rows.write.mode("overwrite").partitionBy(key)
    if per_file:
        writer = writer.option("maxRecordsPerFile", per_file)
    writer.text(path)


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """Absolute name of a folder of the local (or mounted) file system; None for any other store."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        if not spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:"):
            return None
        return os.path.abspath(path)
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else None


def _file_writer(target: str, key: str, per_file: int):
    """Writes sorted (key, line) rows as text files below folders of Spark's partition names; returns no rows.

    A file appears under its name when it is complete, and a task that runs again replaces its files. A job that fails
    leaves the files written so far, without ``_SUCCESS``.
    """

    def name(value: str) -> str:
        return re.sub("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]", lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for value, group in groupby(rows, lambda row: row[0] or ""):
            folder = f"{target}/{name(key)}={name(value)}"
            os.makedirs(folder, exist_ok=True)
            part = 0
            for first in group:
                whole = f"{folder}/part-{task:05d}-{part:05d}.txt"
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with open(draft, "wb") as f:
                    for row in chain([first], islice(group, per_file - 1) if per_file else group):
                        f.write((row[1] or b"") + b"\n")
                os.replace(draft, whole)
                part += 1
        return iter(())

    return run


def read_ocr_results(spark: SparkSession, path: str, page_field: str = "ocrResults") -> tuple[DataFrame, DataFrame]:
    """Recognition result files to (pages, info). A line without pages goes to the pages as a null result.

    Later lines overwrite earlier ones in the merged ``dataInfo``.
    """
    schema = f"result struct<dataInfo:map<string,string>,{page_field}:array<map<string,string>>>"
    d = spark.read.schema(schema).option("mode", "FAILFAST").json(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_line"), "result"
    )
    pages = d.select("path", F.struct("_at", "_line").alias("line_at"), F.posexplode(F.col(f"result.{page_field}")).alias("item_no", "item"))
    entries = d.select("path", F.struct("_at", "_line").alias("_at"), F.explode("result.dataInfo").alias("key", "value"))
    info = entries.groupBy("path", "key").agg(F.max_by("value", "_at").alias("value"))
    return pages, info


def export_segments(df: DataFrame, path: str, fmt: str) -> None:
    """Write utterance rows (video_id, seq, start_time, end_time, text) as srt, txt, json or raw-json."""
    from ..operators.ordered import id_bucket
    from ..operators.subtitles import srt_cues_ms, txt_lines

    if fmt == "srt":
        write_lines(srt_cues_ms(df.withColumn("transcript", F.lit(None).cast("string")), id_bucket(F.col("seq"))), path, ["cue_no"], "cue")
    elif fmt == "txt":
        write_lines(txt_lines(df.select("video_id", "seq", "text")), path, ["seq"], "line")
    elif fmt == "json":
        rows = df.where(F.trim("text") != "").select(
            "video_id", F.col("seq").alias("index"), F.col("start_time").alias("start_ms"), F.col("end_time").alias("end_ms"),
            F.round(F.col("start_time") / 1000.0, 3).alias("start"), F.round(F.col("end_time") / 1000.0, 3).alias("end"), F.trim("text").alias("text"),
        )
        hashed(rows).write.mode("overwrite").partitionBy("bucket").json(path)
    elif fmt == "raw-json":
        hashed(df).write.mode("overwrite").partitionBy("bucket").json(path)
    else:
        raise ValueError(f"Unsupported output format: {fmt}")
