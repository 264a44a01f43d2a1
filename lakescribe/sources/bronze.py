"""Bronze: the write-once archive of raw provider responses (SRC2, SNK1, SNK2).

A record is (provider, endpoint, external_id, fetched_at, payload, ...); its key hashes provider,
endpoint, external id and the canonical payload, so the same response has the same key.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import canonical_json, content_key


class Appended(NamedTuple):
    new: DataFrame
    noop: DataFrame
    conflict: DataFrame


def bronze_records(responses: DataFrame) -> DataFrame:
    """``responses`` with key (sha256) and record_hash (over the whole record, fetched_at included)."""
    payload = F.coalesce(canonical_json(F.col("payload")), F.col("payload"))
    keyed = responses.withColumn("key", content_key(F.col("provider"), F.col("endpoint"), F.col("external_id"), F.sha2(payload, 256)))
    return keyed.withColumn("record_hash", content_key(F.col("key"), F.col("fetched_at").cast("string")))


def bronze_judged(incoming: DataFrame, bronze: DataFrame, on_conflict: str = "error") -> DataFrame:
    """``incoming`` records, equal ones once, with what an append against ``bronze`` would make of them: result new, noop or conflict.

    Unknown keys are new, known keys with an equal record are no-ops, known keys with another record
    conflict. Of several incoming records of one new key the earliest by fetched_at is new and the
    others conflict. ``on_conflict``: "error" keeps conflicts apart for the caller to refuse;
    "keep_first" counts them as no-ops.

    Records are judged by their hashes alone, equal ones folded before the shuffle; payloads meet the
    verdicts in one shuffle, and not at all where the caller does not read them.
    """
    held = bronze.groupBy("key").agg(F.min("record_hash").alias("_held"))
    slim = incoming.select("key", "record_hash", "fetched_at").distinct()
    first = F.min(F.struct("fetched_at", "record_hash")).over(Window.partitionBy("key"))["record_hash"]
    known = F.col("_held").isNotNull()
    new, same = ~known & (F.col("record_hash") == F.col("_first")), known & (F.col("record_hash") == F.col("_held"))
    other = "noop" if on_conflict == "keep_first" else "conflict"
    result = F.when(new, F.lit("new")).when(same, F.lit("noop")).otherwise(F.lit(other))
    judged = slim.withColumn("_first", first).join(held, "key", "left").select("key", "record_hash", result.alias("result"))
    return incoming.dropDuplicates(["key", "record_hash"]).join(judged.hint("merge"), ["key", "record_hash"]).select(*incoming.columns, "result")


def bronze_append(incoming: DataFrame, bronze: DataFrame, on_conflict: str = "error") -> Appended:
    """The records of ``bronze_judged`` by result."""
    judged = bronze_judged(incoming, bronze, on_conflict)
    return Appended(*[judged.filter(F.col("result") == r).drop("result") for r in Appended._fields])


def new_places(incoming: DataFrame, bronze: DataFrame, place: Sequence[str]) -> DataFrame:
    """Where (columns ``place``) the records lie that ``bronze_append`` with "keep_first" finds new, one per key; no payload is read."""
    key = F.unhex("key").alias("key")  # half the length
    first = incoming.groupBy(key).agg(F.min(F.struct("fetched_at", F.unhex("record_hash"), *place)).alias("_first"))
    return first.join(bronze.select(key).hint("merge"), "key", "left_anti").select(*[F.col(f"_first.{c}").alias(c) for c in place])


def bronze_exists(incoming: DataFrame, bronze: DataFrame) -> DataFrame:
    """Those of ``incoming`` whose key is archived."""
    return incoming.join(bronze.select("key"), "key", "left_semi")


def write_bronze(records: DataFrame, path: str) -> None:
    """Append records, partitioned by provider."""
    records.write.mode("append").partitionBy("provider").parquet(path)


def read_bronze(spark: SparkSession, path: str, provider: str | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Archived records; ``provider`` prunes partitions, ``keys`` (key) keeps those only."""
    records = spark.read.parquet(path)
    if provider is not None:
        records = records.filter(F.col("provider") == provider)
    return records if keys is None else records.join(keys.select("key"), "key", "left_semi")
