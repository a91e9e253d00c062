"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a local session gets a folder and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    _FOLDERS.append(f"{root.rstrip('/')}/corpusloom-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


_FOLDERS: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Delete all folders of ``scratch_dir``; call it when results that were read from them have been written or collected."""
    jvm = spark.sparkContext._jvm
    while _FOLDERS:
        path = jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write as Parquet and read back."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
