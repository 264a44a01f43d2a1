"""Intermediate tables in the folder that driver and executors share.

Writing a table cuts lineage: if an executor is lost afterwards, its partitions are read again
instead of being computed again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
#: Bytes of one Arrow batch: a batch is held by the JVM and by the worker at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all runs on one machine."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="lakescribe-"))
    return _local[0]


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, in a folder per value of ``by`` if given, and read it back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakescribe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` at most (or of one longer row) in this session, unless it asks for less."""
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if held > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
