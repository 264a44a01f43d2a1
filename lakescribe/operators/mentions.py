"""Mention counts kept up to date by deltas.

A table of counts per (entity, domain, source, bucket of the publication date) takes a delta per step: a batch of new documents
adds, a source that is deprecated or purged subtracts what it has, one that is made active again adds it back. A document belongs to
one source, domain and bucket and comes in one batch, so numbers of documents add up as numbers of mentions do. A step costs
its own rows: a batch is counted by itself, a source is read by a filter that reaches the scan.

A step has a number and its own folder, which a step that broke off and runs again replaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .analytics import PRECISION, expanded, tallied

KEY = ["entity", "domain", "source_id", "bucket"]
_SHAPE = "entity string, domain string, source_id string, bucket timestamp, mentions long, documents long, step int"


def counted(mentions: DataFrame, grain: str = "week", min_precision: str = "date") -> DataFrame:
    """Mentions and documents per KEY; the bucket is NULL where the date is unknown or too coarse.

    ``mentions`` has a row a mention (entity), of which a count per document comes first, or a row a document (entities), which is cheaper.
    """
    fine = F.col("precision").isin(*PRECISION[: PRECISION.index(min_precision) + 1])
    if "entities" in mentions.columns:
        dated = mentions.select("domain", "source_id", F.when(fine, F.date_trunc(grain, "published_at")).alias("bucket"), "document", "entities")
        found = tallied(dated, "domain", "source_id", "bucket")
        if found is not None:
            return found
        mentions = expanded(mentions)
    keyed = mentions.select("entity", "domain", "source_id", F.when(fine, F.date_trunc(grain, "published_at")).alias("bucket"), "document")
    by_document = keyed.groupBy(*KEY, "document").agg(F.count(F.lit(1)).alias("_n"))
    return by_document.groupBy(*KEY).agg(F.sum("_n").alias("mentions"), F.count(F.lit(1)).alias("documents"))


def _write(rows: DataFrame, path: str, step: int) -> None:
    rows.select(*KEY, "mentions", "documents").write.mode("overwrite").parquet(f"{path}/step={step}")


def current(spark: SparkSession, path: str, before: int | None = None, sources: Sequence[str] | None = None) -> DataFrame:
    """The counts as the steps (those ``before`` a number, of some ``sources``) add up; rows that have come to nothing are gone."""
    rows = spark.read.schema(_SHAPE).parquet(path)
    if before is not None:
        rows = rows.filter(F.col("step") < before)
    if sources is not None:
        rows = rows.filter(F.col("source_id").isin(*sources))
    summed = rows.groupBy(*KEY).agg(F.sum("mentions").alias("mentions"), F.sum("documents").alias("documents"))
    return summed.filter("mentions <> 0 or documents <> 0")


def add_batch(mentions: DataFrame, path: str, step: int, grain: str = "week", min_precision: str = "date") -> None:
    """A batch of documents that are not counted yet."""
    _write(counted(mentions, grain, min_precision), path, step)


def retract(spark: SparkSession, path: str, step: int, sources: Sequence[str]) -> None:
    """What ``sources`` have counted for goes: they are deprecated or purged."""
    own = current(spark, path, step, sources)
    _write(own.withColumns({"mentions": -F.col("mentions"), "documents": -F.col("documents")}), path, step)


def restore(spark: SparkSession, path: str, step: int, retracted: int) -> None:
    """What step ``retracted`` took away comes back: its sources are active again."""
    taken = spark.read.schema(_SHAPE).parquet(path).filter(F.col("step") == retracted)
    _write(taken.withColumns({"mentions": -F.col("mentions"), "documents": -F.col("documents")}), path, step)


def counts(maintained: DataFrame, domain: str | None = None) -> DataFrame:
    """D3 over ``current``: mentions and documents per (entity, domain)."""
    rows = maintained if domain is None else maintained.filter(F.col("domain") == domain)
    return rows.groupBy("entity", "domain").agg(F.sum("mentions").alias("mentions"), F.sum("documents").alias("documents"))


def velocity(maintained: DataFrame) -> DataFrame:
    """D4 over ``current``: mentions per (entity, domain, bucket), and the change from the bucket before that has any."""
    dated = maintained.filter("bucket is not null").groupBy("entity", "domain", "bucket").agg(F.sum("mentions").alias("mentions"))
    before = F.lag("mentions").over(Window.partitionBy("entity", "domain").orderBy("bucket"))
    return dated.withColumn("change", F.col("mentions") - before)
