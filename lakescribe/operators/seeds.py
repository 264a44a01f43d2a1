"""Seed tables: references, defaults, mapping, merging, order and plan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bare_handle, truthy


#: Categories of a mapping that are broadcast at most.
BROADCAST_CATEGORIES = 10_000


def classify_ref(refs: DataFrame, col: str = "raw") -> DataFrame:
    """PRJ9: ``refs`` with kind (video or handle), ref and error; a video id goes before a handle in a URL, that before a bare handle."""
    text = F.trim(F.coalesce(F.col(col), F.lit("")))
    video = F.nullif(F.regexp_extract(text, r"(?:v=|youtu\.be/|shorts/)([A-Za-z0-9_-]{11})", 1), F.lit(""))
    inside = F.nullif(F.regexp_extract(text, r"youtube\.com/(@[\w.-]+)", 1), F.lit(""))
    handle = F.coalesce(inside, F.when(text.startswith("@"), text))
    error = F.when(text == "", F.lit("empty")).when(video.isNull() & handle.isNull(), F.lit("unrecognized"))
    return refs.withColumns({
        "kind": F.when(error.isNull(), F.when(video.isNotNull(), F.lit("video")).otherwise(F.lit("handle"))),
        "ref": F.when(error.isNull(), F.coalesce(video, handle)),
        "error": error,
    })


def owning_channel(refs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Classified references with the channel of a known video (metadata: item_id, channel_id)."""
    return refs.join(metadata.select(F.col("item_id").alias("ref"), "channel_id"), "ref", "left")


def seed_defaults(rows: DataFrame, note: str = "added by hand; review before ingest") -> DataFrame:
    """PRJ10: new seed rows: unknown domain and tier, phase manual-review, the note, subscribers unless 0."""
    return rows.withColumns({"domain": F.lit("unknown"), "authority_tier": F.lit("unknown"), "phase": F.lit("manual-review"), "note": F.lit(note), "subscribers": truthy(F.col("subscribers"))})


def survey_metrics(rows: DataFrame, description: int = 200, tags: int = 12) -> DataFrame:
    """PRJ11: average views per video (half to even; NULL without videos), description and tags cut."""
    return rows.withColumns({
        "avg_views": F.rint(F.col("total_views") / truthy(F.col("videos"))).cast("long"),
        "description": F.substring("description", 1, description),
        "tags": F.slice("tags", 1, tags),
    })


def append_seeds(incoming: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN4: (added, rejected): rows whose handle is in ``seeds``, or came earlier (by ``position``), are rejected with a reason."""
    keyed = incoming.withColumn("_key", bare_handle(F.col("handle")))
    first = F.row_number().over(Window.partitionBy("_key").orderBy("position"))
    held = seeds.select(bare_handle(F.col("handle")).alias("_key")).distinct().withColumn("_held", F.lit(True))
    judged = keyed.withColumn("_first", first).join(held.hint("merge"), "_key", "left")
    fresh = F.col("_held").isNull() & (F.col("_first") == 1)
    return judged.filter(fresh).select(incoming.columns), judged.filter(~fresh).select(*incoming.columns, F.lit("duplicate handle").alias("reason"))


def classify_candidates(candidates: DataFrame, mapping: DataFrame, first_phase: DataFrame, phase: str = "research-p1") -> DataFrame:
    """JN5: resolved candidates with tier and phase of their category; unmapped or excluded categories go.

    ``mapping`` (category, tier, phase; NULL tier excludes) is broadcast up to BROADCAST_CATEGORIES rows, and merged beyond;
    handles in ``first_phase`` get ``phase``.
    """
    tiers = mapping.filter("tier is not null").withColumnRenamed("phase", "_phase")
    small = tiers.limit(BROADCAST_CATEGORIES + 1).count() <= BROADCAST_CATEGORIES
    joined = candidates.filter("resolved").join(F.broadcast(tiers) if small else tiers.hint("merge"), "category")
    early = first_phase.select(bare_handle(F.col("handle")).alias("_key")).distinct().withColumn("_early", F.lit(True))
    joined = joined.withColumn("_key", bare_handle(F.col("handle"))).join(early, "_key", "left")
    return joined.withColumn("phase", F.when(F.col("_early"), F.lit(phase)).otherwise(F.col("_phase"))).drop("_key", "_early", "_phase")


def lookup2(rows: DataFrame, counts: Sequence[DataFrame], key: str = "handle") -> DataFrame:
    """JN6, SE3: ``rows`` with n, by exact key or else by bare key; 0 falls through; of several lists the later wins.

    ``counts`` are (handle, n).
    """
    ranked = reduce(DataFrame.unionByName, [c.select(F.col("handle").alias("_h"), "n").withColumn("_list", F.lit(i)) for i, c in enumerate(counts)])
    exact = ranked.groupBy(F.col("_h").alias(key)).agg(F.max_by("n", "_list").alias("_exact"))
    bare = ranked.groupBy(bare_handle(F.col("_h")).alias("_key")).agg(F.max_by("n", F.struct("_list", "_h")).alias("_bare"))
    joined = rows.withColumn("_key", bare_handle(F.col(key))).join(exact, key, "left").join(bare, "_key", "left")
    return joined.withColumn("n", F.coalesce(truthy(F.col("_exact")), F.col("_bare"))).drop("_key", "_exact", "_bare")


def priority_merge(frames: Sequence[tuple[str, DataFrame]], fill: Sequence[str] = ("videos",), key: str = "handle", position: str = "position") -> DataFrame:
    """WN2, SE1: named lists merged by bare handle: the first list (then position) wins every column.

    ``fill`` columns that are missing or 0 come from the first later row that has them; also_in lists
    the names of the later rows' lists, once per row, in order.
    """
    ranked = [f.withColumns({"_list": F.lit(i), "_name": F.lit(name)}) for i, (name, f) in enumerate(frames)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked).withColumn("_key", bare_handle(F.col(key)))
    place = F.struct("_list", position)
    filled = [F.min_by(truthy(F.col(c)), F.when(truthy(F.col(c)).isNotNull(), place)).alias(c) for c in fill]
    own = [c for c in rows.columns if c not in ("_key", "_list", "_name", *fill)]
    # partial aggregates; a key's lists are counted, one number per list
    merged = rows.groupBy("_key").agg(F.min_by(F.struct(*own, "_name"), place).alias("_best"), *filled, *[F.count_if(F.col("_list") == i).alias(f"_n{i}") for i in range(len(frames))])
    first = F.array_position(F.array(*[F.lit(name) for name, _ in frames]), F.col("_best._name")) - 1
    names = F.flatten(F.array(*[F.array_repeat(F.lit(name), (F.col(f"_n{i}") - (first == i).cast("long")).cast("int")) for i, (name, _) in enumerate(frames)]))
    return merged.select(*[F.col("_best")[c].alias(c) for c in own], *fill, F.col("_best._name").alias("from_list"), names.alias("also_in"))


def order_seeds(seeds: DataFrame, *ties: str) -> DataFrame:
    """SO1: by domain, phase, then videos, most first and NULL as 0, then ``ties``."""
    return seeds.orderBy("domain", "phase", F.coalesce("videos", F.lit(0)).desc(), *ties)


def seed_stats(seeds: DataFrame) -> DataFrame:
    """AG3: channels and videos by domain, most channels first."""
    return seeds.groupBy("domain").agg(F.count(F.lit(1)).alias("channels"), F.sum(F.coalesce("videos", F.lit(0))).alias("videos")).orderBy(F.desc("channels"), "domain")


def resolution_stats(candidates: DataFrame) -> DataFrame:
    """AG4: resolved and total, per category and (category NULL) over all, in one aggregation."""
    totals = candidates.rollup("category").agg(F.count_if("resolved").alias("resolved"), F.count(F.lit(1)).alias("total"), F.grouping("category").alias("overall"))
    return totals.withColumn("rate", F.col("resolved") / F.col("total"))


def ramp_plan(seeds: DataFrame, order: Sequence[str], budget: int, deferred: Sequence[str] = ()) -> DataFrame:
    """WN4: phases in order with channels, credits (one a video) and months so far; deferred phases count nothing."""
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("phase"))
    counted = seeds.filter(place > 0).groupBy("phase").agg(F.first(place).alias("step"), F.count(F.lit(1)).alias("channels"), F.sum(F.coalesce("videos", F.lit(0))).alias("credits"))
    spent = F.when(F.col("phase").isin(*deferred), F.lit(0)).otherwise(F.col("credits")) if deferred else F.col("credits")
    months = F.sum(spent).over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)) / budget
    return counted.withColumn("months", months)  # the window runs over one row per phase of ``order``
