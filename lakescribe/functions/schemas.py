"""The data model: allowed values, keys and references of its tables."""

from __future__ import annotations

#: Allowed values by type.
ENUMS: dict[str, tuple[str, ...]] = {
    "source_kind": ("youtube_channel", "youtube_playlist", "rss", "arxiv", "web"),
    "domain": ("ai_research", "ai_automation", "entrepreneurship", "personal_development", "regulatory", "unknown"),
    "source_status": ("active", "deprecated", "purged"),
    "authority_tier": ("peer_reviewed", "primary_regulatory", "vendor_official", "established_media", "practitioner", "aggregator", "unknown"),
    "transcript_provider": ("supadata", "ytapi", "whisper_local", "restored", "native"),
    "provenance_confidence": ("known", "inferred", "unknown"),
    "date_precision": ("exact", "date", "month", "year", "inferred", "unknown"),
    "attribution_method": ("diarized", "channel_default", "title_parsed", "description_parsed", "unknown"),
    "entity_kind": ("vendor", "person", "technique", "regulation", "product", "organization"),
    "document_status": ("pending", "enriched", "failed", "purged"),
    "summary_method": ("extractive_textrank", "abstractive_llm"),
}

#: Unique keys by table.
UNIQUE: dict[str, tuple[str, ...]] = {
    "tenant": ("slug",),
    "source": ("tenant_id", "kind", "external_id"),
    "document": ("tenant_id", "source_id", "external_id"),
    "transcript_version": ("tenant_id", "document_id", "provider", "lang"),
    "segment": ("transcript_version_id", "idx"),
    "chunk": ("transcript_version_id", "idx"),
    "document_summary": ("document_id", "method"),
    "entity": ("tenant_id", "kind", "canonical_name"),
    "ingest_state": ("tenant_id", "source_id"),
    "heartbeat": ("tenant_id", "flow_name"),
    "chunk_embedding": ("model_version", "chunk_id"),
}

#: References as (child, column, parent, what happens to the child's rows when the parent goes).
REFERENCES: tuple[tuple[str, str, str, str], ...] = (
    ("source", "tenant_id", "tenant", "cascade"),
    ("document", "source_id", "source", "cascade"),
    ("transcript_version", "document_id", "document", "cascade"),
    ("transcript_version", "derived_from_id", "transcript_version", "cascade"),
    ("segment", "transcript_version_id", "transcript_version", "cascade"),
    ("speaker", "document_id", "document", "cascade"),
    ("speaker", "canonical_entity_id", "entity", "set_null"),
    ("utterance", "document_id", "document", "cascade"),
    ("utterance", "speaker_id", "speaker", "cascade"),
    ("chunk", "document_id", "document", "cascade"),
    ("chunk", "transcript_version_id", "transcript_version", "cascade"),
    ("chunk", "speaker_id", "speaker", "set_null"),
    ("document_summary", "document_id", "document", "cascade"),
    ("entity_mention", "entity_id", "entity", "cascade"),
    ("entity_mention", "document_id", "document", "cascade"),
    ("entity_mention", "chunk_id", "chunk", "cascade"),
    ("entity_mention", "speaker_id", "speaker", "set_null"),
    ("ingest_state", "source_id", "source", "cascade"),
    ("chunk_embedding", "chunk_id", "chunk", "cascade"),
)
