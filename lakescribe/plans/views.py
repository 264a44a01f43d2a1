"""The data model's tables as projections of the driver's tables, in Spark and (VIEWS_SQL) in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-20 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed row per document source; a seventh of the video counts are unknown."""
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("n_chars").alias("subscribers"))
    return g.select(
        F.concat(F.lit("@"), F.initcap("source")).alias("handle"), F.col("source").alias("name"), F.concat(F.lit("p"), (F.col("low") % 3 + 1).cast("string")).alias("phase"),
        F.element_at(F.array(F.lit("ai_research"), F.lit("ai_automation"), F.lit("regulatory")), (F.col("low") % 3 + 1).cast("int")).alias("domain"),
        F.when(F.col("low") % 7 != 0, F.col("n")).alias("videos"), "subscribers", F.col("low").alias("position"),
    )


def v_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered items: every document in its source's listing; tenant = language."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("tenant_id"), F.col("source").alias("source_id"), F.col("doc_id").cast("string").alias("external_id"), F.col("doc_id").alias("position"))


def v_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known documents: those with a label; toxic ones have failed."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").cast("string").alias("external_id")).agg(F.max("toxic").alias("toxic"))
    return v_items(spark, sf_dir).join(labels, "external_id").select("tenant_id", "source_id", "external_id", F.when(F.col("toxic") == 1, "failed").otherwise("enriched").alias("status"))


def v_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment per line of a document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return d.select(F.col("doc_id").alias("item"), "idx", "text", (F.col("idx") * 1000).cast("long").alias("offset_ms"), F.length("text").cast("long").alias("duration_ms"))


def v_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("item"), F.col("lang").alias("language_code"), (F.col("doc_id") % 2 == 1).alias("is_generated"), F.col("doc_id").alias("pos"))


def v_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp") + F.make_interval(days=(F.col("event_id") % 30).cast("int"))
    endpoint = F.get_json_object("props", "$.k")
    return e.select(F.col("user_id").alias("tenant_id"), F.col("event_type").alias("provider"), endpoint.alias("endpoint"), F.floor("value").alias("credits"), at.alias("occurred_at"), "event_id")


def v_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt per (user, event type): the event of lowest id."""
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("ok", "unavailable", "invalid", "blocked", "error")]), (F.col("event_id") % 5 + 1).cast("int"))
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item"), F.col("event_type").alias("provider")).agg(F.min("event_id").alias("event_id"))
    return e.withColumn("outcome", outcome)


def v_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("tenant_id"), "event_id", "ts", (1 + F.col("event_id") % 5).alias("cost"))


def v_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, video = table(spark, sf_dir, "pages"), F.lpad(F.col("page_id").cast("string"), 11, "x")
    shapes = [F.concat(F.lit("https://www.youtube.com/watch?v="), video), F.concat(F.lit("https://youtu.be/"), video), F.concat(F.lit("https://youtube.com/@ch."), F.col("page_id")), F.concat(F.lit(" @h-"), F.col("page_id")), F.lit("junk")]
    return p.select("page_id", F.element_at(F.array(*shapes), (F.col("page_id") % 5 + 1).cast("int")).alias("raw"))


def v_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-cased words of documents, a row a document; domain = language, published a day per document id."""
    d = table(spark, sf_dir, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)
    precision = F.element_at(F.array(F.lit("exact"), F.lit("date"), F.lit("month")), (F.col("doc_id") % 3 + 1).cast("int"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 90 * 86400)
    return d.select(words.alias("entities"), F.col("doc_id").alias("document"), F.col("lang").alias("domain"), F.col("source").alias("source_id"), at.alias("published_at"), precision.alias("precision"))


def v_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a row a mention."""
    return v_entities(spark, sf_dir).select(F.explode("entities").alias("entity"), "document", "domain", "source_id", "published_at", "precision")


#: The same views as CTEs for DuckDB.
VIEWS_SQL: dict[str, str] = {
    "v_seeds": """
      SELECT '@' || upper(source[1]) || source[2:] AS handle, source AS name, 'p' || (low % 3 + 1) AS phase, ['ai_research', 'ai_automation', 'regulatory'][low % 3 + 1] AS domain,
             CASE WHEN low % 7 <> 0 THEN n END AS videos, subscribers, low AS position
      FROM (SELECT source, count(*) AS n, min(doc_id) AS low, max(n_chars) AS subscribers FROM documents GROUP BY source)""",
    "v_items": "SELECT lang AS tenant_id, source AS source_id, doc_id::VARCHAR AS external_id, doc_id AS position FROM documents",
    "v_documents": """
      SELECT tenant_id, source_id, external_id, CASE WHEN toxic = 1 THEN 'failed' ELSE 'enriched' END AS status
      FROM (SELECT lang AS tenant_id, source AS source_id, doc_id::VARCHAR AS external_id, doc_id FROM documents) JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)""",
    "v_segments": """
      SELECT doc_id AS item, i AS idx, text, (1000 * i)::BIGINT AS offset_ms, length(text)::BIGINT AS duration_ms
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)""",
    "v_tracks": "SELECT source AS item, lang AS language_code, doc_id % 2 = 1 AS is_generated, doc_id AS pos FROM documents",
    "v_usage": """
      SELECT user_id AS tenant_id, event_type AS provider, json_extract_string(props, '$.k') AS endpoint, floor(value)::BIGINT AS credits, ts + to_days((event_id % 30)::INT) AS occurred_at, event_id FROM events""",
    "v_attempts": """
      SELECT user_id AS item, event_type AS provider, min(event_id) AS event_id, ['ok', 'unavailable', 'invalid', 'blocked', 'error'][min(event_id) % 5 + 1] AS outcome FROM events GROUP BY user_id, event_type""",
    "v_requests": "SELECT user_id AS tenant_id, event_id, ts, 1 + event_id % 5 AS cost FROM events",
    "v_mentions": """
      SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS entity, doc_id AS document, lang AS domain, source AS source_id,
             to_timestamp(1704067200 + doc_id % 90 * 86400) AS published_at, ['exact', 'date', 'month'][doc_id % 3 + 1] AS precision FROM documents""",
}
