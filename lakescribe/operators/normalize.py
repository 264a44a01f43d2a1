"""Normalizers: raw payloads to segments, metadata, outcomes and provenance (PRJ1-PRJ8).

Each takes a frame with ``external_id`` and ``payload`` (JSON text) and adds columns; what cannot be
read goes to a reject frame or becomes NULL, never a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ms_of

#: The payload fields that trim_payload keeps.
KEPT_FIELDS = (
    "id", "title", "description", "duration", "channel", "channel_id", "uploader_id", "timestamp", "upload_date", "view_count",
    "like_count", "comment_count", "tags", "categories", "language", "availability", "subtitles", "automatic_captions",
)


def _get(path: str, kind: str, payload: str = "_v") -> Column:
    return F.try_variant_get(payload, path, kind)


def _parsed(bronze: DataFrame) -> DataFrame:
    return bronze.withColumn("_v", F.try_parse_json("payload"))


def judged_segments_ms(bronze: DataFrame) -> DataFrame:
    """``bronze`` with segments, offsets being whole milliseconds, and whether the item is rejected; a payload is parsed once.

    ``content`` as an array gives a segment per element (idx from 0, missing duration 0), as a string
    one segment at 0; missing or null content means there is no transcript, an empty array a
    transcript without segments. An element without text or offset rejects the item.
    """
    parsed = _parsed(bronze)
    listed = _get("$.content", "array<struct<text:string,offset:double,duration:double>>")
    plain = F.when(listed.isNull(), _get("$.content", "string"))
    parsed = parsed.withColumns({"_list": listed, "_plain": plain})
    bad = F.coalesce(F.exists("_list", lambda e: e.isNull() | e["text"].isNull() | e["offset"].isNull()), F.lit(False))
    one = F.array(F.struct(F.lit(0).alias("idx"), F.col("_plain").alias("text"), F.lit(0).cast("long").alias("offset_ms"), F.lit(0).cast("long").alias("duration_ms")))
    many = F.transform(
        "_list", lambda e, i: F.struct(i.alias("idx"), e["text"].alias("text"), e["offset"].cast("long").alias("offset_ms"), F.coalesce(e["duration"].cast("long"), F.lit(0)).alias("duration_ms"))
    )
    return parsed.withColumns({"segments": F.when(F.col("_list").isNotNull(), many).when(F.col("_plain").isNotNull(), one), "rejected": bad}).drop("_v", "_list", "_plain")


def normalize_segments_ms(bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of ``judged_segments_ms``, the items with has_transcript."""
    judged = judged_segments_ms(bronze).withColumn("has_transcript", F.col("segments").isNotNull())
    return judged.filter("not rejected").drop("rejected"), judged.filter("rejected").select(bronze.columns)


def judged_segments_s(bronze: DataFrame) -> DataFrame:
    """``bronze`` with segments from ``snippets`` in seconds, rounded half to even (missing duration 0), and whether the item is rejected.

    Without ``snippets`` there is no transcript; an element without text or start rejects the item.
    """
    listed = _get("$.snippets", "array<struct<text:string,start:double,duration:double>>")
    parsed = _parsed(bronze).withColumn("_list", listed)
    bad = F.coalesce(F.exists("_list", lambda e: e.isNull() | e["text"].isNull() | e["start"].isNull()), F.lit(False))
    many = F.transform(
        "_list", lambda e, i: F.struct(i.alias("idx"), e["text"].alias("text"), ms_of(e["start"]).alias("offset_ms"), F.coalesce(ms_of(e["duration"]), F.lit(0)).alias("duration_ms"))
    )
    return parsed.withColumns({"segments": many, "rejected": bad}).drop("_v", "_list")


def normalize_segments_s(bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rejects) of ``judged_segments_s``."""
    judged = judged_segments_s(bronze)
    return judged.filter("not rejected").drop("rejected"), judged.filter("rejected").select(bronze.columns)


def document_fields(bronze: DataFrame) -> DataFrame:
    """``bronze`` (a metadata payload) with url, title, description and duration_s of the document."""
    own = F.coalesce(F.nullif(_get("$.id", "string"), F.lit("")), F.col("external_id"))
    return (
        _parsed(bronze)
        .withColumns({
            "url": F.concat(F.lit("https://www.youtube.com/watch?v="), own), "title": _get("$.title", "string"),
            "description": _get("$.description", "string"), "duration_s": _get("$.duration", "double").cast("long"),
        })
        .drop("_v")
    )


def normalize_metadata(bronze: DataFrame) -> DataFrame:
    """``bronze`` with item_id, published_at, precision, date_source, and sorted caption languages.

    A timestamp other than 0 is exact, else an upload_date (yyyymmdd) is of day precision, else unknown.
    """
    stamp = F.nullif(_get("$.timestamp", "bigint"), F.lit(0))
    day = F.try_to_timestamp(F.when(_get("$.upload_date", "string").rlike("^[0-9]{8}$"), _get("$.upload_date", "string")), F.lit("yyyyMMdd"))
    precision = F.when(stamp.isNotNull(), F.lit("exact")).when(day.isNotNull(), F.lit("date")).otherwise(F.lit("unknown"))

    def languages(path: str) -> Column:
        return F.array_sort(F.map_keys(_get(path, "map<string,variant>")))

    return (
        _parsed(bronze)
        .withColumns({
            "item_id": F.coalesce(F.nullif(_get("$.id", "string"), F.lit("")), F.col("external_id")),
            "published_at": F.coalesce(F.timestamp_seconds(stamp), day),
            "precision": precision,
            "date_source": F.when(precision != "unknown", F.lit("api")),
            "subtitle_langs": languages("$.subtitles"),
            "caption_langs": languages("$.automatic_captions"),
        })
        .drop("_v")
    )


def normalize_metadata_api(bronze: DataFrame) -> DataFrame:
    """``bronze`` with published_at and precision from an ISO ``uploadDate``, and channel, tags and counts as extra.

    A date without a time counts as exact too.
    """
    at = F.try_to_timestamp(_get("$.uploadDate", "string"))
    extra = F.struct(_get("$.channel.id", "string").alias("channel_id"), _get("$.channel.name", "string").alias("channel_name"), _get("$.tags", "array<string>").alias("tags"), _get("$.viewCount", "bigint").alias("view_count"))
    return (
        _parsed(bronze)
        .withColumns({"published_at": at, "precision": F.when(at.isNotNull(), F.lit("exact")).otherwise(F.lit("unknown")), "date_source": F.when(at.isNotNull(), F.lit("api")), "extra": extra})
        .drop("_v")
    )


def trim_payload(bronze: DataFrame, keep: tuple[str, ...] = KEPT_FIELDS) -> DataFrame:
    """``bronze`` with the payload's other top-level fields gone."""
    fields = F.map_filter(F.try_variant_get(F.try_parse_json("payload"), "$", "map<string,variant>"), lambda k, _: k.isin(*keep))
    return bronze.withColumn("payload", F.to_json(fields))


def outcome_of(status: Column) -> Column:
    """ok, invalid, blocked, unavailable or retryable, from an HTTP status."""
    return (
        F.when(status.isin(200, 202), F.lit("ok"))
        .when(status == 400, F.lit("invalid"))
        .when(status == 404, F.lit("unavailable"))
        .when(status.between(500, 599), F.lit("retryable"))
        .otherwise(F.lit("blocked"))
    )


def classify_response(responses: DataFrame, status: str = "http_status") -> DataFrame:
    return responses.withColumn("outcome", outcome_of(F.col(status)))


def assign_provenance(items: DataFrame) -> DataFrame:
    """``items`` (provider_unit "s" or "ms", is_generated, http_status) with is_auto_generated and provenance_confidence.

    The seconds provider says so itself; the milliseconds one tells by status 202 only. NULL stays NULL.
    """
    says, hints = F.col("provider_unit") == "s", (F.col("provider_unit") == "ms") & (F.col("http_status") == 202)
    return items.withColumns({
        "is_auto_generated": F.when(says, F.col("is_generated")).when(hints, F.lit(True)),
        "provenance_confidence": F.when(says, F.lit("known")).when(hints, F.lit("inferred")).otherwise(F.lit("unknown")),
    })


#: Transcript normalizers by provider, with the unit of its times: records with segments and rejected. Adding a source adds an entry.
TRANSCRIPTS = {"supadata": (judged_segments_ms, "ms"), "native": (judged_segments_ms, "ms"), "ytapi": (judged_segments_s, "s")}
#: Metadata normalizers by provider, the preferred one first.
METADATA = {"ytdlp": normalize_metadata, "supadata": normalize_metadata_api}
