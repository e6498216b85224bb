"""Intermediate tables in the folder that driver and executors share.

Plans that use a costly intermediate several times write it once.  Later work, retries after a lost executor included,
reads the table.  Who has read all of it may delete it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only a single-process local master may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + os.path.join(tempfile.gettempdir(), "graniteseek-" + uuid.uuid4().hex))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def staged(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read back, so that later work doesn't redo earlier work."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._staged = path
    return out


def unstaged(*frames: DataFrame | None) -> None:
    """Deletes tables that `staged` wrote, once all that reads them is written itself."""
    for frame in frames:
        path = getattr(frame, "_staged", None)
        if path:
            context = frame.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
            frame._staged = None
