"""Mixing sources to target weights (operator 5), DataFrame functions only.

Every document has a size in words. A source's share of all words follows its weight, but a source
is repeated ``cap`` times at most; what it cannot supply is shared again by weight among the others.
The repetition rate of a source is target / size, and a document is emitted floor(rate) times plus
once more when a hash of its id falls below the fraction.

Defined results: null text has size 0; a null source is a source of its own, ranked last; sources
without words get target 0 and their documents are not emitted; an empty table gives no rows; rows
with the same id draw the same number, so they are copied alike; extra columns pass through
``mix_documents`` and working columns are prefixed ``_mix_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
#: A table of targets with at most this many rows is broadcast (some 100 bytes a row); a larger one is merge-joined.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of the key's MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sized: DataFrame, source: str, size: str, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target) per source of a table with sizes.

    Sources are ranked by code point, null last, and get ``weights`` in turn. Filling stops for the
    sources of least ``cap * size / weight`` first, so the level of all others follows from running
    sums over the sources in that order. The windows run over one row per source, in one task that
    sorts and spills; each is a running sum or a whole one, so their work is linear in the sources.
    """
    n = len(weights)
    totals = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    ranked = totals.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("_rank") - 1) % n + 1).cast("int"))
    ranked = ranked.withColumn("_weight", weight.cast("long")).withColumn("_cap", F.col("source_size") * cap)
    order = Window.orderBy(F.col("_ratio"), F.col("_rank"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = (
        ranked.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(whole))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_rest", F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
        .withColumn("_level", F.col("_left") / F.col("_rest"))
        .withColumn("_open", F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_rank", "_level")))
    )
    level = F.min("_open").over(whole)["_level"]
    return leveled.select("source", "source_size", F.least(F.col("_weight") * level, F.col("_cap").cast("double")).alias("target"))


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """``docs`` with _mix_size, _mix_source_size, _mix_target and _mix_copies (how often the mix emits the row)."""
    sized = docs.withColumn("_mix_size", word_count(F.col(text_col)))
    targets = stored(source_targets(sized, source_col, "_mix_size", weights, cap), "targets").select(
        F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target")
    )
    targets = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets.hint("merge")
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(0.0))
    extra = (uniform(F.col(id_col), seed) < rate - F.floor(rate)).cast("long")
    return sized.join(targets, F.col(source_col).eqNullSafe(F.col("_mix_source"))).withColumn("_mix_copies", F.floor(rate).cast("long") + extra).drop("_mix_source")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its source's rate says, same columns, whatever their names."""
    held = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    copied = with_copies(held, "id", "text", "source", **options).filter("_mix_copies > 0")
    return copied.select("row", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))).select("row.*")
