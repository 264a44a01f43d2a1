"""Folders for datasets that a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder, in the same file system."""
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"cannot rename {path} to {to}")


def remove(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the cluster's checkpoints; a temporary one only where none are configured and all runs on one machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="lakescribe-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"
