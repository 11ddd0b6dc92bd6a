"""Written intermediate tables for results that several later steps read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def staging_dir(spark: SparkSession) -> str:
    """Shared folder that the session names in spark.checkpoint.dir.

    A session that runs in one process (master `local[..]`) and names none gets a temporary folder of its own
    that goes with the process; any other session without the setting is an error, since executors have no common disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write once as Parquet and read back: lineage ends here and a lost executor costs nothing upstream."""
    path = f"{staging_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
