"""Session settings that operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Set a checkpoint folder where neither the session nor its context has one, as in tests.

    Only a session of one machine gets a temporary folder: executors of a cluster would each write to their own disk.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"spark.checkpoint.dir is not set: {context.master} needs a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="kelpline-"))
    return spark


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or with_checkpoints(spark).sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
