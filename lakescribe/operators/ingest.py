"""Incremental ingest: what is new, which provider answers, and the silver tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import truthy
from .normalize import METADATA, TRANSCRIPTS, assign_provenance, document_fields, outcome_of

ITEM = ["tenant_id", "source_id", "external_id"]
#: Columns of a document and of a transcript beside keys and status; NULL is unknown.
DOCUMENT = {"url": "string", "title": "string", "description": "string", "duration_s": "bigint", "published_at": "timestamp", "published_at_precision": "string", "published_at_source": "string"}
TRANSCRIPT = {"is_auto_generated": "boolean", "provenance_confidence": "string", "available_langs": "array<string>"}
SEGMENTS = "array<struct<idx:int,text:string,offset_ms:bigint,duration_ms:bigint>>"
#: What a record may carry beside key, payload and time.
OPTIONAL = {"http_status": "int", "is_generated": "boolean", "available_langs": "array<string>"}
#: Outcomes that end the failover.
TERMINAL = ("ok", "unavailable", "invalid")


def new_items(discovered: DataFrame, documents: DataFrame, retry_failed: bool = False) -> DataFrame:
    """JN1: distinct discovered items without a document, whatever its status (``retry_failed``: failed ones count as absent)."""
    held = documents.filter("status != 'failed'") if retry_failed else documents
    return discovered.dropDuplicates(ITEM).join(held.select(ITEM), ITEM, "left_anti")


def known_items(discovered: DataFrame, documents: DataFrame) -> DataFrame:
    """JN2: distinct discovered items that have a document."""
    return discovered.dropDuplicates(ITEM).join(documents.select(ITEM), ITEM, "left_semi")


def upsert_sources(seeds: DataFrame, sources: DataFrame) -> DataFrame:
    """JN3: ``sources`` plus the seeds whose (tenant_id, kind, external_id) is absent; existing rows are never changed."""
    key = ["tenant_id", "kind", "external_id"]
    return sources.unionByName(seeds.dropDuplicates(key).join(sources.select(key), key, "left_anti"), allowMissingColumns=True)


def limit_per_source(discovered: DataFrame, limit: int | None = None, caps: DataFrame | None = None, source: str = "source_id", position: str = "position") -> DataFrame:
    """WN3: the first items in listing order per source: the smaller of ``limit`` and the source's cap, 0 or NULL being no limit.

    ``caps`` has (source, cap), a row per source at most. Sources without a limit are not ranked; of the others the window keeps
    the first rows up to the largest limit in every task, before anything is shuffled.
    """
    if caps is None:
        rows, most = discovered, truthy(F.lit(limit).cast("int"))
        largest = limit
    else:
        rows = discovered.join(caps.select(source, F.col("cap").alias("_cap")), source, "left")
        most = F.least(truthy(F.lit(limit).cast("int")), truthy(F.col("_cap")))
        largest = limit or caps.agg(F.max(truthy(F.col("cap")))).first()[0]
    if not largest:
        return rows.drop("_cap")
    ranked = rows.filter(most.isNotNull()).withColumn("_rank", F.row_number().over(Window.partitionBy(source).orderBy(position)))
    first = ranked.filter(F.col("_rank") <= largest).filter(F.col("_rank") <= most).drop("_rank")
    return (first if limit else first.unionByName(rows.filter(most.isNull()))).drop("_cap")


def select_track(tracks: DataFrame, language: str, item: str = "item") -> DataFrame:
    """WN1: per item the caption track to read: wanted language first, then written by hand, then listing order."""
    order = Window.partitionBy(item).orderBy((F.col("language_code") == language).desc_nulls_last(), F.col("is_generated").asc(), F.col("pos").asc())
    return tracks.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def available_languages(tracks: DataFrame, item: str = "item") -> DataFrame:
    """AG6: sorted distinct languages of an item's caption tracks."""
    return tracks.groupBy(item).agg(F.array_sort(F.collect_set("language_code")).alias("languages"))


def transcript_text(segments: DataFrame, key: str = "transcript_id") -> DataFrame:
    """AG5: segment texts joined by one space in idx order."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return segments.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("text"))


def resolve_attempts(attempts: DataFrame, order: Sequence[str], item: str = "item") -> DataFrame:
    """AG8, JN7: per item the provider that settles it, trying ``order`` in turn.

    ``attempts`` has an outcome per (item, provider): ok, unavailable and invalid end the search,
    blocked and others go on; providers without an attempt are skipped. Gives chosen_provider (ok
    only), error, attempts_made and final_outcome. An item without any attempt in ``order`` gets
    no-provider-available.
    """
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("provider"))
    ended = F.col("outcome").isin(*TERMINAL)
    tried = attempts.withColumn("_ord", F.when(place > 0, place)).withColumn("_end", F.when(ended, F.col("_ord")))
    found = tried.groupBy(item).agg(
        F.min_by(F.struct("provider", "outcome"), "_end").alias("_settled"),
        F.max_by("outcome", "_ord").alias("_last"),
        F.min("_end").alias("_at"),
        F.sort_array(F.collect_set("_ord")).alias("_tried"),
    )
    outcome = F.coalesce(F.col("_settled.outcome"), F.col("_last"))
    error = (
        F.when(outcome == "ok", F.lit(None))
        .when(outcome == "unavailable", F.lit("transcript-unavailable"))
        .when(outcome == "invalid", F.lit("invalid-request"))
        .when(outcome == "blocked", F.lit("provider-blocked"))
        .when(outcome.isNotNull(), F.lit("provider-error"))
        .otherwise(F.lit("no-provider-available"))
    )
    made = F.size(F.filter("_tried", lambda o: F.col("_at").isNull() | (o <= F.col("_at"))))
    return found.select(item, F.when(outcome == "ok", F.col("_settled.provider")).alias("chosen_provider"), error.alias("error"), made.alias("attempts_made"), outcome.alias("final_outcome"))


def check_order(order: Sequence[str], known: Sequence[str]) -> None:
    """A configured provider that does not exist is an error."""
    unknown = [p for p in order if p not in known]
    if unknown:
        raise ValueError(f"unknown providers: {unknown}")


def cross_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """JN8: segments (item, idx, text, offset_ms, duration_ms) in which two providers differ, with what each has."""
    fields = ["text", "offset_ms", "duration_ms"]
    left = a.select("item", "idx", F.struct(*fields).alias("a"))
    right = b.select("item", "idx", F.struct(*fields).alias("b"))
    return left.join(right.hint("merge"), ["item", "idx"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))


class Silver(NamedTuple):
    documents: DataFrame
    transcripts: DataFrame
    segments: DataFrame


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with NULL in those of ``columns`` (name: type) that it lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def latest_records(records: DataFrame) -> DataFrame:
    """One record per item, provider and endpoint: the latest by (fetched_at, key), so that every run picks the same."""
    by = [*ITEM, "provider", "endpoint"]
    rest = [c for c in records.columns if c not in by]
    return records.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("fetched_at", "key")).alias("_r")).select(*by, "_r.*")


def judged_answers(own: DataFrame, order: Sequence[str]) -> DataFrame:
    """Transcript records of the providers in ``order`` with segments, rejected, provider_unit and outcome.

    A record without a transcript stands for the outcome of its http_status (none: unavailable), a rejected one for an error.
    """
    check_order(order, tuple(TRANSCRIPTS))
    spoken, readers = own.filter("endpoint = 'transcript'"), {}
    for provider in order:
        readers.setdefault(TRANSCRIPTS[provider], []).append(provider)
    parts = [read(spoken.filter(F.col("provider").isin(*providers))).withColumn("provider_unit", F.lit(unit)) for (read, unit), providers in readers.items()]
    said = outcome_of(F.col("http_status"))
    outcome = F.when(F.col("rejected"), F.lit("error")).when(F.col("segments").isNotNull(), F.lit("ok")).when(F.col("http_status").isNotNull() & (said != "ok"), said).otherwise(F.lit("unavailable"))
    return reduce(DataFrame.unionByName, parts).withColumn("outcome", outcome)


def settled_items(own: DataFrame, judged: DataFrame, order: Sequence[str]) -> DataFrame:
    """Every item of ``judged`` answers or of metadata among ``own`` records: the provider that settles it, or an error, and what the metadata say."""
    settled = resolve_attempts(judged.select(F.struct(*ITEM).alias("item"), "provider", "outcome"), order).select("item.*", F.col("chosen_provider").alias("provider"), "error")
    dated = []
    for place, (provider, read) in enumerate(METADATA.items()):
        part = read(document_fields(own.filter((F.col("endpoint") == "metadata") & (F.col("provider") == provider))))
        renamed = part.withColumnsRenamed({"precision": "published_at_precision", "date_source": "published_at_source"})
        dated.append(renamed.select(*ITEM, F.lit(place).alias("_place"), F.struct(*DOCUMENT).alias("_d")))
    known = reduce(DataFrame.unionByName, dated).groupBy(*ITEM).agg(F.min_by("_d", "_place").alias("_d"))
    return settled.join(known, ITEM, "full_outer").select(*ITEM, "provider", F.coalesce("error", F.when(F.col("provider").isNull(), F.lit("no-provider-available"))).alias("error"), "_d.*")


def normalized_items(records: DataFrame, order: Sequence[str] = tuple(TRANSCRIPTS)) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of bronze records of all providers: an item's transcript by failover in ``order``, and its metadata.

    A rejected record stands for an error, on which the next provider is asked. ``records`` may have http_status,
    is_generated and available_langs. Missing metadata leaves NULLs, never a guess.
    """
    own = latest_records(with_columns(records, OPTIONAL))
    judged = judged_answers(own, order)
    found = judged.filter("not rejected").select(*ITEM, "provider", "lang", "segments", *OPTIONAL, "provider_unit")
    joined = settled_items(own, judged, order).join(assign_provenance(found).drop("provider_unit", "http_status", "is_generated").hint("merge"), [*ITEM, "provider"], "left")
    return joined, judged.filter("rejected").select(own.columns)


def fan_out(items: DataFrame) -> Silver:
    """SNK3, PRJ8: documents (enriched with a transcript, else failed), transcripts, and segments of normalized items.

    Items may have the columns of ``DOCUMENT`` and ``TRANSCRIPT``; those they lack are NULL. Surrogate
    ids hash the natural keys, so a replay writes the same rows. Items with the column ``spoken`` (whether there is a
    transcript) need no segments for the other two tables.
    """
    document_id = F.sha2(F.concat_ws("|", *ITEM), 256)
    keyed = with_columns(items, DOCUMENT | TRANSCRIPT | {"segments": SEGMENTS}).withColumn("document_id", document_id)
    spoken = F.col("spoken") if "spoken" in items.columns else F.col("segments").isNotNull()
    status = F.when(spoken, F.lit("enriched")).otherwise(F.lit("failed"))
    documents = keyed.select("document_id", *ITEM, *DOCUMENT, status.alias("status"))
    transcript_id = F.sha2(F.concat_ws("|", "document_id", "provider", "lang"), 256)
    transcripts = keyed.filter(spoken).select(transcript_id.alias("transcript_id"), "document_id", "tenant_id", "provider", "lang", *TRANSCRIPT)
    # no condition on the segments themselves: Spark would move it below what makes them, and parse each payload again for every mention
    ids, said = ["transcript_id", "document_id", "tenant_id"], F.when(spoken, F.col("segments")) if "spoken" in items.columns else F.col("segments")
    exploded = keyed.withColumn("transcript_id", transcript_id).select(*ids, F.posexplode_outer(said).alias("_pos", "s"))
    segments = exploded.filter("_pos is not null").select(*ids, "s.*")
    return Silver(documents, transcripts, segments)


def ingest_errors(outcomes: DataFrame, source: str = "source_id") -> DataFrame:
    """AG2: (source, error) of every failed item, a row each."""
    return outcomes.filter("outcome = 'failed'").select(source, "error")


def ingest_summary(outcomes: DataFrame, source: str = "source_id") -> DataFrame:
    """AG2: per source the items discovered, known already, fetched and failed; refused items are in no bucket. Errors are in ``ingest_errors``."""
    count = lambda kind: F.count_if(F.col("outcome") == kind)
    return outcomes.groupBy(source).agg(
        F.count(F.lit(1)).alias("discovered"), count("already").alias("already"), count("fetched").alias("fetched"), count("failed").alias("failed")
    )


def upsert_state(state: DataFrame, touched: DataFrame, now) -> DataFrame:
    """SE2: a row per (tenant_id, source_id); touched ones get updated_at = now, their other columns are kept."""
    key = ["tenant_id", "source_id"]
    joined = state.join(touched.select(key).distinct().withColumn("_touched", F.lit(True)), key, "full_outer")
    return joined.withColumn("updated_at", F.when(F.col("_touched"), now).otherwise(F.col("updated_at"))).select(state.columns)
