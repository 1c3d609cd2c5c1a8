"""Folders for files that a job writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; it goes when the driver's JVM ends.

    Where none is named, a local session gets a temporary one; elsewhere that is an error, as executors don't share it.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    folder = f"{root}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def shared(df: DataFrame, name: str) -> DataFrame:
    """df, worked out once and read by all its consumers; as Parquet in a new folder, so that a lost executor costs nothing."""
    folder = new_folder(df.sparkSession, name) + "/rows"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
