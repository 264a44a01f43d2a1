"""Seed scan (SRC1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import bare_handle


def filter_seeds(seeds: DataFrame, phase: str | None = None, handle: str | None = None) -> DataFrame:
    """Seed rows of a phase (exact) and of a handle (without @ signs and case); both must fit."""
    if phase is not None:
        seeds = seeds.filter(F.col("phase") == phase)
    return seeds if handle is None else seeds.filter(bare_handle(F.col("handle")) == bare_handle(F.lit(handle)))


def read_seeds(spark: SparkSession, path: str, phase: str | None = None, handle: str | None = None) -> DataFrame:
    """Seeds from JSON lines (path ends in .json or .jsonl) or Parquet."""
    reader = spark.read.json if path.endswith((".json", ".jsonl")) else spark.read.parquet
    return filter_seeds(reader(path), phase, handle)
