"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only on one machine where that is unset, as in tests.

    Raises on a cluster without it: executors would write to their own disks, where nobody else finds the files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _OWN.setdefault(spark.sparkContext.applicationId, "")
        if not path:
            path = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="trivium-")
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/trivium-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return f"{folder}/{name}"


def mark(spark: SparkSession) -> int:
    """The number of folders that this application has written so far."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, start: int = 0, stop: int | None = None) -> int:
    """Delete the folders from mark start to mark stop, or all; results that still read them must be stored before."""
    jvm, folders = spark.sparkContext._jvm, _WRITTEN.get(spark.sparkContext.applicationId, [])
    gone = [f for f in folders[start:stop] if f]
    for folder in gone:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    folders[start:stop] = [""] * len(folders[start:stop])  # marks keep their places
    return len(gone)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts the lineage: an executor lost later costs only the tasks that read these files.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(stored: DataFrame) -> DataFrame:
    """A table that has just been stored, once Spark may delete the shuffle files it came from.

    Spark does so when the driver's garbage collector finds that nobody needs them, which may be much later: long jobs would hold the
    files of all their steps.
    """
    gc.collect()
    stored.sparkSession.sparkContext._jvm.System.gc()
    return stored
