"""Queries over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import at_handle, bare_handle, base_language, cap_of
from ..functions.schemas import ENUMS, REFERENCES
from ..functions.storage import fresh_folder
from ..operators import analytics, ingest, lifecycle, mentions, normalize, quality, seeds, tenancy, usage
from ..sources import bronze, intake, lake
from ..sources import seeds as seed_source
from ..streaming import jobs
from . import views
from .views import NOW, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            used = [v for v in views.VIEWS_SQL if re.search(rf"\b{v}\b", sql)]
            heads = ", ".join(f"{v} AS ({views.VIEWS_SQL[v]})" for v in used)
            start, own = re.match(r"\s*(WITH RECURSIVE |WITH |)(.*)", sql, re.S).groups()
            SQL[f.__name__] = f"{start or 'WITH '}{heads}{', ' if start else ' '}{own}" if used else sql.strip()
        return f

    return register


def now():
    return F.lit(NOW).cast("timestamp")


# usage


@query(f"""
SELECT tenant_id, provider, coalesce(sum(credits) FILTER (occurred_at >= date_trunc('day', TIMESTAMP '{NOW}')), 0)::BIGINT AS today,
       coalesce(sum(credits) FILTER (occurred_at >= date_trunc('month', TIMESTAMP '{NOW}')), 0)::BIGINT AS "month",
       coalesce(sum(credits) FILTER (occurred_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAYS), 0)::BIGINT AS last_30d, true AS has_data,
       coalesce(sum(credits) FILTER (occurred_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAYS), 0) / 30.0::DOUBLE AS avg_per_day
FROM v_usage GROUP BY ALL""")
def ag1_usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_summary(views.v_usage(spark, sf_dir), now())


@query(f"""
WITH keys AS (SELECT DISTINCT user_id AS tenant_id FROM events UNION SELECT -1)
SELECT tenant_id, provider, coalesce(sum(credits) FILTER (occurred_at >= date_trunc('day', TIMESTAMP '{NOW}')), 0)::BIGINT AS today,
       coalesce(sum(credits) FILTER (occurred_at >= date_trunc('month', TIMESTAMP '{NOW}')), 0)::BIGINT AS "month",
       coalesce(sum(credits) FILTER (occurred_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAYS), 0)::BIGINT AS last_30d, count(credits) > 0 AS has_data,
       coalesce(sum(credits) FILTER (occurred_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAYS), 0) / 30.0::DOUBLE AS avg_per_day
FROM (SELECT tenant_id, 'click' AS provider FROM keys) LEFT JOIN v_usage USING (tenant_id, provider) GROUP BY ALL""")
def ag1_usage_with_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.v_usage(spark, sf_dir)
    keys = events.select("tenant_id").union(spark.range(1).select(F.lit(-1).cast("long"))).select("tenant_id", F.lit("click").alias("provider"))
    return usage.usage_summary(events, now(), keys)


@query("""
SELECT *, rank() OVER (PARTITION BY period ORDER BY credits DESC)::INT AS rank
FROM (SELECT strftime(date_trunc('day', occurred_at), '%Y-%m-%d') AS period, endpoint, provider, sum(credits)::BIGINT AS credits FROM v_usage GROUP BY ALL)""")
def d9_spend_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = usage.spend_by(views.v_usage(spark, sf_dir), "day", ["endpoint", "provider"])
    return spent.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query("SELECT tenant_id, event_id, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, event_id) <= 20 AS admitted FROM v_requests")
def wn5_admit_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.admit_unit(views.v_requests(spark, sf_dir), 20, order=["ts", "event_id"]).select("tenant_id", "event_id", "admitted")


@query("""
WITH RECURSIVE ordered AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, event_id) AS k FROM v_requests),
fold AS (
  SELECT tenant_id, k, event_id, cost <= 60 AS admitted, CASE WHEN cost <= 60 THEN cost ELSE 0 END AS spent FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.tenant_id, o.k, o.event_id, f.spent + o.cost <= 60, CASE WHEN f.spent + o.cost <= 60 THEN f.spent + o.cost ELSE f.spent END
  FROM fold f JOIN ordered o ON o.tenant_id = f.tenant_id AND o.k = f.k + 1)
SELECT tenant_id, event_id, admitted FROM fold""")
def wn5_admit_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.admit(views.v_requests(spark, sf_dir), 60, order=["ts", "event_id"]).select("tenant_id", "event_id", "admitted")


# tenancy


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def flt1_tenant_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenancy.tenant_view(table(spark, sf_dir, "documents").select("doc_id", "lang"), "de", "lang")


@query("SELECT event_id, user_id FROM events WHERE user_id IS NULL OR user_id <> 7")
def flt2_write_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tenancy.tenant_violations(table(spark, sf_dir, "events").select("event_id", "user_id"), "7", "user_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_custkey = 10 AND o_orderkey % 2 = 0)")
def flt3_tenant_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return tenancy.tenant_delete(orders, orders.filter("o_orderkey % 2 = 0"), "10", ["o_orderkey"], "o_custkey")


# quality


def _provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.element_at(F.array(*[F.lit(x) for x in ("known", "inferred", "unknown")]), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 2 == 0).alias("is_auto_generated"), confidence.alias("provenance_confidence"))


@query("SELECT event_id FROM events WHERE (event_id % 4 = 0) <> (event_id % 3 = 2)")
def ck1_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.provenance_violations(_provenance(spark, sf_dir)).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O') OR o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def ck2_allowed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.enum_violations(table(spark, sf_dir, "orders"), {"o_orderstatus": ["F", "O"], "o_orderpriority": ["1-URGENT", "2-HIGH"]}).select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE text IS NULL OR lang IS NULL OR length(text) > 2000 OR length(source) > 4")
def ck3_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.shape_violations(table(spark, sf_dir, "documents"), ["text", "lang"], {"text": 2000, "source": 4}).select("doc_id")


@query("SELECT vec_id FROM embeddings WHERE embedding IS NULL OR len(embedding) <> 64 OR label NOT IN (0, 1, 2, 3, 4)")
def ck3_vector_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    bad = quality.shape_violations(vectors, ["embedding"], sizes={"embedding": 64}).union(quality.enum_violations(vectors, {"label": [0, 1, 2, 3, 4]}, nullable=["label"]))
    return bad.select("vec_id").distinct()


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def ag7_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unique_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')")
def jn9_fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_orders = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    return quality.fk_violations(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), open_orders, "l_orderkey", "o_orderkey")


# bronze


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    payload = F.to_json(F.struct(F.col("lang"), F.col("text").alias("content")))
    return d.select(F.col("source").alias("provider"), F.lit("transcript").alias("endpoint"), (F.col("doc_id") % 500).cast("string").alias("external_id"), (F.col("doc_id") % 2).alias("fetched_at"), payload.alias("payload"), "doc_id", "text", "lang")


@query("""
WITH r AS (SELECT source, doc_id % 500 AS x, doc_id % 2 AS f, text, lang, doc_id FROM documents),
held AS (SELECT DISTINCT source, x, text, lang, f FROM r WHERE doc_id % 3 = 0), h AS (SELECT source, x, text, lang, min(f) AS f0, count(*) AS n FROM held GROUP BY ALL),
inc AS (SELECT source, x, text, lang, f FROM r WHERE doc_id % 3 <> 0 OR doc_id % 2 = 1 UNION SELECT source, x, text, lang, f + 7 FROM r WHERE doc_id % 21 = 0),
one AS (SELECT i.*, h.f0, h.n, min(i.f) OVER (PARTITION BY i.source, i.x, i.text, i.lang) AS first FROM inc i LEFT JOIN h USING (source, x, text, lang))
SELECT CASE WHEN f0 IS NULL AND f = first THEN 'new' WHEN f0 IS NOT NULL AND f = f0 THEN 'noop' ELSE 'conflict' END AS result, count(*) AS n FROM one GROUP BY ALL""")
def snk1_bronze_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = bronze.bronze_records(_responses(spark, sf_dir))
    held = records.filter("doc_id % 3 = 0")
    held = held.groupBy("key").agg(F.min_by("record_hash", "fetched_at").alias("record_hash"))
    late = bronze.bronze_records(_responses(spark, sf_dir).filter("doc_id % 21 = 0").withColumn("fetched_at", F.col("fetched_at") + 7))
    judged = bronze.bronze_judged(records.filter("doc_id % 3 <> 0 or doc_id % 2 = 1").unionByName(late), held)
    return judged.groupBy("result").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 3 = 0 AND o.source = d.source AND o.doc_id % 500 = d.doc_id % 500 AND o.text = d.text AND o.lang = d.lang)")
def snk2_bronze_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = bronze.bronze_records(_responses(spark, sf_dir))
    return bronze.bronze_exists(records, records.filter("doc_id % 3 = 0")).select("doc_id")


@query("SELECT doc_id FROM documents d WHERE source = (SELECT min(source) FROM documents) AND EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 4 = 0 AND o.source = d.source AND o.doc_id % 500 = d.doc_id % 500 AND o.text = d.text AND o.lang = d.lang)")
def src2_bronze_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all responses, written, and read back for one provider and some keys."""
    path, records = fresh_folder(spark, "bronze"), bronze.bronze_records(_responses(spark, sf_dir))
    bronze.write_bronze(records, path)
    provider = table(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    keys = records.filter("doc_id % 4 = 0").select("key").distinct()
    return bronze.read_bronze(spark, path, provider, keys).select("doc_id")


@query("SELECT handle, phase, videos FROM v_seeds WHERE phase = 'p2'")
def src1_seed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_source.filter_seeds(views.v_seeds(spark, sf_dir), "p2").select("handle", "phase", "videos")


@query("SELECT handle, phase FROM v_seeds WHERE lower(handle) = '@src7'")
def src1_seed_by_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_source.filter_seeds(views.v_seeds(spark, sf_dir), handle="@@SRC7").select("handle", "phase")


# normalizers


def _segment_payloads(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    """Payloads of four shapes by doc_id % 4: elements (every other one without duration), a string, null, no elements; and ``more`` columns."""
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct(t.alias("text"), (i * 1000).alias("offset"), F.when(i % 2 == 0, F.length(t)).alias("duration")))
    shape = F.col("doc_id") % 4  # a case, so that a row makes its own shape only
    payload = (
        F.when(shape == 0, F.to_json(F.struct(lines.alias("content"))))
        .when(shape == 1, F.to_json(F.struct(F.col("text").alias("content"))))
        .when(shape == 2, F.lit('{"content": null}'))
        .otherwise(F.lit('{"content": []}'))
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("external_id"), payload.alias("payload"), *more)


@query("""
SELECT item AS doc_id, idx::INT AS idx, text, offset_ms, CASE WHEN idx % 2 = 0 THEN duration_ms ELSE 0 END AS duration_ms FROM v_segments WHERE item % 4 = 0
UNION ALL SELECT doc_id, 0, text, 0, 0 FROM documents WHERE doc_id % 4 = 1""")
def prj1_segments_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = normalize.normalize_segments_ms(_segment_payloads(spark, sf_dir))
    return items.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.*")


@query("SELECT doc_id, doc_id % 4 <> 2 AS has_transcript FROM documents")
def prj1_transcript_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize_segments_ms(_segment_payloads(spark, sf_dir))[0].select("doc_id", "has_transcript")


@query("SELECT event_id, round_even(round(value, 4) * 1000, 0)::BIGINT AS offset_ms, CASE WHEN event_id % 2 = 0 THEN round_even(round(value, 4) / 2 * 1000, 0)::BIGINT ELSE 0 END AS duration_ms FROM events")
def prj2_segments_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.round("value", 4)
    snippet = F.struct(F.lit("t").alias("text"), start.alias("start"), F.when(F.col("event_id") % 2 == 0, start / 2).alias("duration"))
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.array(snippet).alias("snippets"))).alias("payload"))
    return normalize.normalize_segments_s(e)[0].select("event_id", F.explode("segments").alias("s")).select("event_id", "s.offset_ms", "s.duration_ms")


def _epoch(col: str):
    return F.unix_timestamp(F.col(col).cast("timestamp"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN epoch(o_orderdate)::BIGINT WHEN o_orderkey % 3 = 1 THEN epoch(date_trunc('day', o_orderdate))::BIGINT END AS published,
       CASE o_orderkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'date' ELSE 'unknown' END AS precision, CASE WHEN o_orderkey % 3 < 2 THEN 'api' END AS date_source,
       o_orderkey::VARCHAR AS item_id, 'de,en' AS languages FROM orders""")
def prj3_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, shape = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    fields = F.struct(
        F.when(shape == 0, _epoch("o_orderdate")).otherwise(F.lit(0)).alias("timestamp"), F.when(shape == 1, F.date_format("o_orderdate", "yyyyMMdd")).when(shape == 2, F.lit("soon")).alias("upload_date"),
        F.when(shape == 1, F.lit("")).otherwise(F.col("o_orderkey").cast("string")).alias("id"), F.struct(F.lit("x").alias("en"), F.lit("y").alias("de")).alias("subtitles"),
    )
    m = normalize.normalize_metadata(o.select("o_orderkey", F.col("o_orderkey").cast("string").alias("external_id"), F.to_json(fields).alias("payload")))
    return m.select("o_orderkey", F.unix_timestamp("published_at").alias("published"), "precision", "date_source", "item_id", F.array_join("subtitle_langs", ",").alias("languages"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN epoch(o_orderdate)::BIGINT END AS published, CASE WHEN o_orderkey % 2 = 0 THEN 'exact' ELSE 'unknown' END AS precision, 'c' || o_custkey AS channel_id, o_custkey AS view_count
FROM orders""")
def prj4_metadata_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.struct(
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("o_orderkey") % 4 == 1, F.lit("never")).alias("uploadDate"),
        F.struct(F.concat(F.lit("c"), F.col("o_custkey")).alias("id")).alias("channel"), F.col("o_custkey").alias("viewCount"),
    )
    m = normalize.normalize_metadata_api(table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(fields).alias("payload")))
    return m.select("o_orderkey", F.unix_timestamp("published_at").alias("published"), "precision", "extra.channel_id", "extra.view_count")


@query("""SELECT event_id, '{"id":' || event_id || ',"tags":["' || event_type || '"]}' AS payload FROM events""")
def prj5_trim_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.struct(F.col("event_id").alias("id"), F.array("event_type").alias("tags"), F.col("value").alias("formats"), F.col("props").alias("thumbnails"))
    return normalize.trim_payload(table(spark, sf_dir, "events").select("event_id", F.to_json(fields).alias("payload")))


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = [200, 202, 400, 401, 402, 404, 429, 500, 503, 302]
    return table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("event_id") % 10 + 1).cast("int")).alias("http_status"))


_STATUS_SQL = "[200, 202, 400, 401, 402, 404, 429, 500, 503, 302][event_id % 10 + 1]"


@query(f"""
SELECT event_id, CASE WHEN s IN (200, 202) THEN 'ok' WHEN s = 400 THEN 'invalid' WHEN s = 404 THEN 'unavailable' WHEN s BETWEEN 500 AND 599 THEN 'retryable' ELSE 'blocked' END AS outcome
FROM (SELECT event_id, {_STATUS_SQL} AS s FROM events)""")
def prj6_classify_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.classify_response(_status(spark, sf_dir)).select("event_id", "outcome")


@query(f"""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id % 4 = 0 WHEN s = 202 THEN true END AS is_auto_generated,
       CASE WHEN event_id % 2 = 0 THEN 'known' WHEN s = 202 THEN 'inferred' ELSE 'unknown' END AS provenance_confidence
FROM (SELECT event_id, {_STATUS_SQL} AS s FROM events)""")
def prj7_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _status(spark, sf_dir).withColumns({"provider_unit": F.when(F.col("event_id") % 2 == 0, "s").otherwise("ms"), "is_generated": F.col("event_id") % 4 == 0})
    return normalize.assign_provenance(items).select("event_id", "is_auto_generated", "provenance_confidence")


# ingest


@query("SELECT tenant_id, source_id, external_id FROM v_items ANTI JOIN v_documents USING (tenant_id, source_id, external_id)")
def jn1_new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.new_items(views.v_items(spark, sf_dir), views.v_documents(spark, sf_dir)).select(ingest.ITEM)


@query("SELECT tenant_id, source_id, external_id FROM v_items ANTI JOIN (SELECT * FROM v_documents WHERE status <> 'failed') USING (tenant_id, source_id, external_id)")
def jn1_new_items_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.new_items(views.v_items(spark, sf_dir), views.v_documents(spark, sf_dir), retry_failed=True).select(ingest.ITEM)


@query("SELECT tenant_id, source_id, external_id FROM v_items SEMI JOIN v_documents USING (tenant_id, source_id, external_id)")
def jn2_known_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.known_items(views.v_items(spark, sf_dir), views.v_documents(spark, sf_dir)).select(ingest.ITEM)


@query("""
SELECT DISTINCT lang AS tenant_id, 'web' AS kind, source AS external_id, CASE WHEN source IN ('src1', 'src2') THEN 'old' ELSE 'new' END AS title FROM documents""")
def jn3_upsert_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("tenant_id"), F.lit("web").alias("kind"), F.col("source").alias("external_id"))
    held = d.filter("external_id in ('src1', 'src2')").distinct().withColumn("title", F.lit("old"))
    return ingest.upsert_sources(d.withColumn("title", F.lit("new")), held)


@query("""
SELECT source_id, external_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY position) AS k, CASE WHEN source_id = 'src1' THEN 3 WHEN source_id = 'src2' THEN 0 WHEN source_id = 'src3' THEN 50 END AS cap FROM v_items)
WHERE k <= least(10, coalesce(nullif(cap, 0), 10))""")
def wn3_limit_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = {"src1": "big; CAP at 3", "src2": "CAP at 0", "src3": "CAP at  50 now", "src4": "no cap"}
    note = F.create_map(*[F.lit(x) for pair in notes.items() for x in pair])[F.col("source_id")]
    items = views.v_items(spark, sf_dir)
    caps = items.select("source_id").distinct().withColumn("cap", cap_of(note))
    return ingest.limit_per_source(items, 10, caps).select("source_id", "external_id")


@query("SELECT item, language_code, is_generated, pos FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY language_code = 'de' DESC, is_generated, pos) AS k FROM v_tracks) WHERE k = 1")
def wn1_select_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.select_track(views.v_tracks(spark, sf_dir), "de")


@query("SELECT item, array_to_string(list_sort(list(DISTINCT language_code)), ',') AS languages FROM v_tracks GROUP BY item")
def ag6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.available_languages(views.v_tracks(spark, sf_dir)).withColumn("languages", F.array_join("languages", ","))


@query("SELECT conv_id AS transcript_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def ag5_transcript_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("idx"), "text")
    return ingest.transcript_text(c)


_ORDER = ("view", "click", "purchase", "signup")


@query(f"""
WITH placed AS (SELECT *, list_position([{', '.join(repr(p) for p in _ORDER)}], provider) AS o FROM v_attempts),
ended AS (SELECT item, min(o) FILTER (outcome IN ('ok', 'unavailable', 'invalid')) AS e, max(o) AS last FROM placed GROUP BY item),
final AS (SELECT item, e, last, (SELECT min(outcome) FROM placed p WHERE p.item = ended.item AND p.o = coalesce(e, last)) AS outcome, (SELECT min(provider) FROM placed p WHERE p.item = ended.item AND p.o = e) AS provider FROM ended)
SELECT item, CASE WHEN outcome = 'ok' THEN provider END AS chosen_provider,
       CASE WHEN outcome = 'ok' THEN NULL WHEN outcome = 'unavailable' THEN 'transcript-unavailable' WHEN outcome = 'invalid' THEN 'invalid-request' WHEN outcome = 'blocked' THEN 'provider-blocked'
            WHEN outcome IS NOT NULL THEN 'provider-error' ELSE 'no-provider-available' END AS error,
       (SELECT count(*) FROM placed p WHERE p.item = final.item AND p.o <= coalesce(e, 99))::INT AS attempts_made, outcome AS final_outcome
FROM final""")
def ag8_resolve_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.resolve_attempts(views.v_attempts(spark, sf_dir), _ORDER)


@query("""
WITH a AS (SELECT * FROM v_segments WHERE item % 5 <> 0), b AS (SELECT item, idx, text, offset_ms + CASE WHEN idx % 7 = 3 THEN 1 ELSE 0 END AS offset_ms, duration_ms FROM v_segments WHERE item % 5 <> 1)
SELECT coalesce(a.item, b.item) AS item, coalesce(a.idx, b.idx)::INT AS idx, a.item IS NULL AS only_b, b.item IS NULL AS only_a
FROM a FULL JOIN b ON a.item = b.item AND a.idx = b.idx WHERE a.item IS NULL OR b.item IS NULL OR a.text <> b.text OR a.offset_ms <> b.offset_ms OR a.duration_ms <> b.duration_ms""")
def jn8_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.v_segments(spark, sf_dir)
    shifted = s.filter("item % 5 <> 1").withColumn("offset_ms", F.col("offset_ms") + F.when(F.col("idx") % 7 == 3, 1).otherwise(0))
    return ingest.cross_check(s.filter("item % 5 <> 0"), shifted).select("item", "idx", F.col("a").isNull().alias("only_b"), F.col("b").isNull().alias("only_a"))


def _silver(spark: SparkSession, sf_dir: str) -> ingest.Silver:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("tenant_id"), F.col("source").alias("source_id"), "lang")
    items, _ = normalize.normalize_segments_ms(_segment_payloads(spark, sf_dir))
    return ingest.fan_out(items.join(d, "doc_id").withColumn("provider", F.lit("native")))


@query("SELECT doc_id::VARCHAR AS external_id, sha256(lang || '|' || source || '|' || doc_id) AS document_id, CASE WHEN doc_id % 4 = 2 THEN 'failed' ELSE 'enriched' END AS status FROM documents")
def snk3_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver(spark, sf_dir).documents.select("external_id", "document_id", "status")


@query("""
WITH ids AS (SELECT doc_id, sha256(sha256(lang || '|' || source || '|' || doc_id) || '|native|' || lang) AS transcript_id FROM documents)
SELECT transcript_id, count(*) AS segments, sum(offset_ms)::BIGINT AS offsets
FROM (SELECT item, offset_ms FROM v_segments WHERE item % 4 = 0 UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id % 4 = 1) JOIN ids ON item = doc_id GROUP BY ALL""")
def snk3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver(spark, sf_dir).segments.groupBy("transcript_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("offset_ms").alias("offsets"))


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of three providers: supadata (blocked for every fifth document, four shapes), ytapi where that is blocked, metadata for two thirds."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("tenant_id"), F.col("source").alias("source_id"), "lang", "n_chars", "text")
    d, blocked = d.withColumn("fetched_at", F.col("doc_id") % 3), F.col("doc_id") % 5 == 0
    none, langs = F.lit(None).cast("boolean"), F.lit(None).cast("array<string>")
    key = ["tenant_id", "source_id", "external_id", "lang", "fetched_at"]
    more = [c.alias(name) for name, c in (("tenant_id", F.col("lang")), ("source_id", F.col("source")), ("lang", F.col("lang")), ("fetched_at", F.col("doc_id") % 3))]
    one = _segment_payloads(spark, sf_dir, *more).select(
        F.lit("supadata").alias("provider"), F.lit("transcript").alias("endpoint"), *key, F.when(blocked, F.lit("{}")).otherwise(F.col("payload")).alias("payload"),
        F.when(blocked, 429).otherwise(200).alias("http_status"), none.alias("is_generated"), langs.alias("available_langs"),
    )
    d = d.withColumn("external_id", F.col("doc_id").cast("string"))
    snippet = F.to_json(F.struct(F.array(F.struct("text", F.lit(1.5).alias("start"))).alias("snippets")))
    two = d.filter(blocked).select(F.lit("ytapi"), F.lit("transcript"), *key, snippet, F.lit(200), F.col("doc_id") % 2 == 0, F.array("lang"))
    about = F.to_json(F.struct(F.col("external_id").alias("id"), F.col("lang").alias("title"), F.col("n_chars").alias("duration"), (F.lit(1704067200) + F.col("doc_id")).alias("timestamp")))
    three = d.filter("doc_id % 3 <> 0").select(F.lit("ytdlp"), F.lit("metadata"), *key, about, F.lit(200), none, langs)
    return one.union(two).union(three)


_WHOLE = """
SELECT doc_id::VARCHAR AS external_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 4 <> 2 THEN 'enriched' ELSE 'failed' END AS status, CASE WHEN doc_id % 3 <> 0 THEN 'https://www.youtube.com/watch?v=' || doc_id END AS url,
       CASE WHEN doc_id % 3 <> 0 THEN lang END AS title, CASE WHEN doc_id % 3 <> 0 THEN n_chars END::BIGINT AS duration_s, CASE WHEN doc_id % 3 <> 0 THEN 1704067200 + doc_id END::BIGINT AS published,
       CASE WHEN doc_id % 3 <> 0 THEN 'exact' END AS published_at_precision, CASE WHEN doc_id % 5 = 0 THEN 'ytapi' WHEN doc_id % 4 <> 2 THEN 'supadata' END AS provider,
       CASE WHEN doc_id % 5 = 0 THEN doc_id % 2 = 0 END AS is_auto_generated, CASE WHEN doc_id % 5 = 0 THEN 'known' WHEN doc_id % 4 <> 2 THEN 'unknown' END AS provenance_confidence,
       CASE WHEN doc_id % 5 = 0 THEN lang END AS langs FROM documents"""


def _whole(silver: ingest.Silver) -> DataFrame:
    t = silver.transcripts.select("document_id", "provider", "is_auto_generated", "provenance_confidence", F.array_join("available_langs", ",").alias("langs"))
    joined = silver.documents.join(t.hint("merge"), "document_id", "left")
    return joined.select("external_id", "status", "url", "title", "duration_s", F.unix_timestamp("published_at").alias("published"), "published_at_precision", "provider", "is_auto_generated", "provenance_confidence", "langs")


@query(_WHOLE)
def d1_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver rows of archived responses of all providers, with the failover and the metadata."""
    return _whole(analytics.rebuild(bronze.bronze_records(_recorded(spark, sf_dir)))[0])


@query(_WHOLE)
def st4_ingest_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same responses through the incremental ingest, in two batches by item, the second replayed."""
    path, raw = fresh_folder(spark, "lake"), _recorded(spark, sf_dir)
    for part in ("cast(external_id as long) % 2 = 0", "cast(external_id as long) % 2 = 1", "cast(external_id as long) % 2 = 1"):
        jobs.ingest_batch(raw.filter(part), path)
    return _whole(lake.read_silver(spark, path))


@query(f"SELECT 'forward' AS fed, * FROM ({_WHOLE}) UNION ALL SELECT 'backward', * FROM ({_WHOLE}) UNION ALL SELECT 'compacted', * FROM ({_WHOLE})")
def st4_late_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each provider's responses come in a batch of their own, in two orders; the tables equal a rebuild, before and after they are compacted."""
    raw, batches, found = _recorded(spark, sf_dir), ["supadata", "ytapi", "ytdlp"], []
    for fed, order in (("forward", batches), ("backward", batches[::-1])):
        path = fresh_folder(spark, "lake")
        for provider in order:
            jobs.ingest_batch(raw.filter(F.col("provider") == provider), path)
        found.append(_whole(lake.read_silver(spark, path)).select(F.lit(fed).alias("fed"), "*"))
    lake.compact(spark, path, bronze.bronze_records(ingest.with_columns(raw, ingest.OPTIONAL)).schema, 16)  # a reader from before still reads its runs
    return found[0].union(found[1]).union(_whole(lake.read_silver(spark, path)).select(F.lit("compacted").alias("fed"), "*"))


@query("""
WITH t AS (SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 4 <> 2),
s AS (SELECT count(*) AS n FROM documents WHERE doc_id % 5 = 0 OR doc_id % 4 = 1 UNION ALL SELECT count(DISTINCT item) FROM v_segments WHERE item % 4 = 0 AND item % 5 <> 0 AND idx = 0)
SELECT 'document' AS table_name, 'unique tenant_id,source_id,external_id' AS rule, 0 AS violations UNION ALL SELECT 'transcript_version', 'unique tenant_id,document_id,provider,lang', 0
UNION ALL SELECT 'segment', 'unique transcript_version_id,idx', sum(n)::BIGINT FROM s UNION ALL SELECT 'segment', 'transcript_version_id in transcript_version', 0
UNION ALL SELECT 'transcript_version', 'document_id in document', count(*) FROM t WHERE doc_id % 7 = 0""")
def ag7_jn9_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's keys and references over rebuilt silver tables that lack every seventh document and have first segments twice."""
    silver = analytics.rebuild(bronze.bronze_records(_recorded(spark, sf_dir)))[0]
    segments = silver.segments.withColumnRenamed("transcript_id", "transcript_version_id")
    return quality.model_violations({
        "document": silver.documents.filter("cast(external_id as long) % 7 <> 0"), "transcript_version": silver.transcripts.withColumnRenamed("transcript_id", "transcript_version_id"),
        "segment": segments.union(segments.filter("idx = 0")),
    })


@query("""
WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 0 OR doc_id % 4 <> 2 THEN 1 ELSE 0 END AS good, 1 + (doc_id % 5 = 0)::INT + (doc_id % 3 <> 0)::INT AS records FROM documents),
b AS (SELECT 'first' AS batch, *, false AS known FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT 'second', *, doc_id % 2 = 0 FROM d)
SELECT batch || ':' || source AS run_id, count(*) AS total, count(*) AS current, count(*) FILTER (good = 1 AND NOT known) AS fetched, count(*) FILTER (known) AS skipped, count(*) FILTER (good = 0 AND NOT known) AS failed,
       CASE WHEN count(*) FILTER (good = 0 AND NOT known) > 0 THEN 'partial' ELSE 'complete' END AS status, coalesce(sum(records) FILTER (NOT known), 0)::BIGINT AS credits
FROM b GROUP BY batch, source""")
def st2_ingest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progress rows that two overlapping batches of an ingest write, folded: per batch and source the AG2 summary."""
    path, raw = fresh_folder(spark, "lake"), _recorded(spark, sf_dir)
    for run, batch in (("first", raw.filter("cast(external_id as long) % 2 = 0")), ("second", raw)):
        jobs.ingest_batch(batch, path, sink=f"{path}/progress", run=run)
    return jobs.run_progress(spark.read.parquet(f"{path}/progress")).drop("detail")


@query("""
SELECT event_type AS source_id, count(*) AS discovered, count(*) FILTER (event_id % 4 = 0) AS already, count(*) FILTER (event_id % 4 = 1) AS fetched, count(*) FILTER (event_id % 4 = 2) AS failed FROM events GROUP BY ALL""")
def ag2_ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest_summary(_outcomes(spark, sf_dir))


@query("SELECT event_type AS source_id, 'e' || event_id AS error FROM events WHERE event_id % 4 = 2")
def ag2_ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest_errors(_outcomes(spark, sf_dir))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("already", "fetched", "failed", "budget_exceeded")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id"), outcome.alias("outcome"), F.concat(F.lit("e"), F.col("event_id")).alias("error"))


@query("""
WITH s AS (SELECT user_id AS tenant_id, event_type AS source_id, max(event_id) AS cursor, max(ts) AS at FROM events WHERE event_id % 2 = 0 GROUP BY ALL), t AS (SELECT DISTINCT user_id AS tenant_id, event_type AS source_id FROM events WHERE event_id % 2 = 1)
SELECT coalesce(s.tenant_id, t.tenant_id) AS tenant_id, coalesce(s.source_id, t.source_id) AS source_id, s.cursor, floor(epoch(CASE WHEN t.tenant_id IS NOT NULL THEN TIMESTAMP '2024-02-20 12:00:00' ELSE s.at END))::BIGINT AS updated
FROM s FULL JOIN t ON s.tenant_id = t.tenant_id AND s.source_id = t.source_id""")
def se2_upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumnsRenamed({"user_id": "tenant_id", "event_type": "source_id"})
    state = e.filter("event_id % 2 = 0").groupBy("tenant_id", "source_id").agg(F.max("event_id").alias("cursor"), F.max("ts").cast("timestamp").alias("updated_at"))
    return ingest.upsert_state(state, e.filter("event_id % 2 = 1"), now()).select("tenant_id", "source_id", "cursor", F.unix_timestamp("updated_at").alias("updated"))


# seeds


@query("""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'video' WHEN 2 THEN 'handle' WHEN 3 THEN 'handle' END AS kind,
       CASE page_id % 5 WHEN 0 THEN lpad(page_id::VARCHAR, 11, 'x') WHEN 1 THEN lpad(page_id::VARCHAR, 11, 'x') WHEN 2 THEN '@ch.' || page_id WHEN 3 THEN '@h-' || page_id END AS ref,
       CASE WHEN page_id % 5 = 4 THEN 'unrecognized' END AS error FROM pages""")
def prj9_classify_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.classify_ref(views.v_refs(spark, sf_dir)).select("page_id", "kind", "ref", "error")


@query("SELECT lpad(page_id::VARCHAR, 11, 'x') AS ref, page_id, CASE WHEN page_id % 10 = 0 THEN 'c' || page_id END AS channel_id FROM pages WHERE page_id % 5 < 2")
def prj9_owning_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "pages").filter("page_id % 10 = 0").select(F.lpad(F.col("page_id").cast("string"), 11, "x").alias("item_id"), F.concat(F.lit("c"), F.col("page_id")).alias("channel_id"))
    return seeds.owning_channel(seeds.classify_ref(views.v_refs(spark, sf_dir)).filter("kind = 'video'"), known).select("ref", "page_id", "channel_id")


@query("SELECT handle, 'unknown' AS domain, 'unknown' AS authority_tier, 'manual-review' AS phase, nullif(videos, 50) AS subscribers FROM v_seeds")
def prj10_seed_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.v_seeds(spark, sf_dir).select("handle", F.when(F.col("videos") == 50, 0).otherwise(F.col("videos")).alias("subscribers"))
    return seeds.seed_defaults(rows).drop("note")


@query("""
SELECT p_partkey, round_even((p_partkey * 37)::DOUBLE / nullif(p_size % 10, 0), 0)::BIGINT AS avg_views, substr(p_name, 1, 5) AS description FROM part""")
def prj11_survey_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", (F.col("p_partkey") * 37).alias("total_views"), (F.col("p_size") % 10).alias("videos"), F.col("p_name").alias("description"), F.split("p_type", " ").alias("tags"))
    return seeds.survey_metrics(rows, 5).select("p_partkey", "avg_views", "description")


@query("""
WITH i AS (SELECT '@' || source AS handle, doc_id AS position FROM documents), j AS (SELECT *, row_number() OVER (PARTITION BY lower(handle) ORDER BY position) AS k FROM i)
SELECT handle, position, CASE WHEN k > 1 OR lower(handle) IN (SELECT lower(handle) FROM v_seeds WHERE phase = 'p1') THEN 'duplicate handle' ELSE 'added' END AS result FROM j""")
def jn4_append_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = table(spark, sf_dir, "documents").select(at_handle(F.col("source")).alias("handle"), F.col("doc_id").alias("position"))
    added, rejected = seeds.append_seeds(incoming, views.v_seeds(spark, sf_dir).filter("phase = 'p1'"))
    return added.withColumn("result", F.lit("added")).union(rejected.withColumnRenamed("reason", "result"))


@query("""
SELECT c_name AS handle, r_name AS category, 'tier' || r_regionkey AS tier, CASE WHEN c_custkey % 5 = 0 THEN 'research-p1' ELSE 'phase' || r_regionkey END AS phase
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3 AND c_custkey % 4 <> 0""")
def jn5_classify_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    mapping = r.filter("r_regionkey < 4").select(F.col("r_name").alias("category"), F.when(F.col("r_regionkey") < 3, F.concat(F.lit("tier"), F.col("r_regionkey"))).alias("tier"), F.concat(F.lit("phase"), F.col("r_regionkey")).alias("phase"))
    of = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("category"))
    rows = c.join(F.broadcast(of), "c_nationkey").select(F.col("c_name").alias("handle"), "category", (F.col("c_custkey") % 4 != 0).alias("resolved"))
    early = c.filter("c_custkey % 5 = 0").select(F.concat(F.lit("@"), F.lower("c_name")).alias("handle"))
    return seeds.classify_candidates(rows, mapping, early).select("handle", "category", "tier", "phase")


@query("""
SELECT c_name AS handle, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 100 WHEN c_custkey % 2 = 0 THEN c_custkey + 1 END::BIGINT AS n FROM customer""")
def jn6_lookup2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    first = c.filter("c_custkey % 2 = 0").select(F.concat(F.lit("@"), F.lower("c_name")).alias("handle"), (F.col("c_custkey") + 1).cast("long").alias("n"))
    second = c.filter("c_custkey % 3 = 0").select(F.col("c_name").alias("handle"), (F.col("c_custkey") + 100).cast("long").alias("n"))
    zero = c.select(F.col("c_name").alias("handle"), F.lit(0).cast("long").alias("n")).filter("handle = 'none'")
    return seeds.lookup2(c.select(F.col("c_name").alias("handle")), [zero, first, second])


@query("""
WITH rows AS (
  SELECT 0 AS l, 'customers' AS name, 'N' || c_nationkey % 20 AS handle, nullif(c_custkey % 4, 0) AS videos, c_custkey AS position FROM customer
  UNION ALL SELECT 1, 'suppliers', '@n' || s_nationkey, nullif(s_suppkey % 3, 0), s_suppkey FROM supplier),
k AS (SELECT *, lower(ltrim(handle, '@')) AS key, row_number() OVER (PARTITION BY lower(ltrim(handle, '@')) ORDER BY l, position) AS r FROM rows)
SELECT key, max(handle) FILTER (r = 1) AS handle, max(name) FILTER (r = 1) AS from_list, max(position) FILTER (r = 1) AS position, arg_min(videos, r) FILTER (videos IS NOT NULL) AS videos,
       coalesce(string_agg(name, ',' ORDER BY r) FILTER (r > 1), '') AS also_in FROM k GROUP BY key""")
def wn2_priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("N"), (F.col("c_nationkey") % 20)).alias("handle"), (F.col("c_custkey") % 4).alias("videos"), F.col("c_custkey").alias("position"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("@n"), F.col("s_nationkey")).alias("handle"), (F.col("s_suppkey") % 3).alias("videos"), F.col("s_suppkey").alias("position"))
    merged = seeds.priority_merge([("customers", c), ("suppliers", s)])
    return merged.select(bare_handle(F.col("handle")).alias("key"), "handle", "from_list", "position", "videos", F.array_join("also_in", ",").alias("also_in"))


@query("SELECT p_brand AS domain, count(*) AS channels, sum(coalesce(nullif(p_size % 6, 0), 0))::BIGINT AS videos FROM part GROUP BY ALL")
def ag3_seed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("domain"), F.nullif(F.col("p_size") % 6, F.lit(0)).alias("videos"))
    return seeds.seed_stats(p)


@query("""
SELECT quality AS category, count(*) FILTER (toxic = 0) AS resolved, count(*) AS total, grouping(quality)::INT AS overall, (count(*) FILTER (toxic = 0))::DOUBLE / count(*) AS rate FROM labels GROUP BY ROLLUP (quality)""")
def ag4_resolution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("category"), (F.col("toxic") == 0).alias("resolved"))
    return seeds.resolution_stats(rows).withColumn("overall", F.col("overall").cast("int"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_type, coalesce(nullif(p_size % 6, 0), 0) DESC, p_partkey)::INT AS place FROM part")
def so1_order_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("domain"), F.col("p_type").alias("phase"), F.nullif(F.col("p_size") % 6, F.lit(0)).alias("videos"))
    path = fresh_folder(spark, "ordered")
    seeds.order_seeds(p, "p_partkey").select("p_partkey", F.monotonically_increasing_id().alias("at")).write.parquet(path)
    # a number is its partition's number times 2^33, and the place in the partition
    ordered = spark.read.parquet(path).withColumn("part", F.shiftright("at", 33))
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    return ordered.join(before.hint("merge"), "part").select("p_partkey", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int").alias("place"))


@query("SELECT tenant_id, source_id, external_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY position) AS k FROM v_items) WHERE k <= 3")
def so2_discovery_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.limit_per_source(views.v_items(spark, sf_dir), 3).select(ingest.ITEM)


@query("SELECT DISTINCT unnest(['@h' || page_id % 50, '@c' || page_id]) AS handle, 'unknown' AS domain, 'manual-review' AS phase FROM pages")
def st1_intake_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch that the intake stream hands on: a dropped file per page, with a handle that many share and a channel's URL."""
    p = table(spark, sf_dir, "pages")
    listed = F.array(F.to_json(F.struct(F.concat(F.lit("@h"), F.col("page_id") % 50).alias("handle"))), F.to_json(F.struct(F.concat(F.lit("https://youtube.com/@c"), F.col("page_id")).alias("url"))), F.lit('{"url": "junk"}'))
    files = p.select(F.col("page_id").cast("string").alias("path"), F.lit(0).alias("mtime"), F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("value"))
    return jobs.intake_rows(files, views.v_seeds(spark, sf_dir))[0].select("handle", "domain", "phase")


@query("""
WITH p AS (SELECT l_returnflag AS phase, list_position(['R', 'A', 'N'], l_returnflag) AS step, count(*) AS channels, sum(l_quantity::BIGINT)::BIGINT AS credits FROM lineitem GROUP BY ALL)
SELECT phase, step::BIGINT AS step, channels, credits, sum(CASE WHEN phase = 'N' THEN 0 ELSE credits END) OVER (ORDER BY step)::DOUBLE / 30000 AS months FROM p WHERE step IS NOT NULL""")
def wn4_ramp_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("phase"), F.rint("l_quantity").cast("long").alias("videos"))
    plan = seeds.ramp_plan(rows, ["R", "A", "N"], 30_000, ["N"])
    return plan.withColumn("step", F.col("step").cast("long"))


@query("SELECT position, base FROM (SELECT doc_id AS position, split_part(lang || '-' || source, '-', 1) AS base FROM documents)")
def fn_base_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), base_language(F.concat_ws("-", "lang", "source")).alias("base"))


# lifecycle


_CHAIN: list[lifecycle.Reference] = [
    ("nation", "r_regionkey", "region", "r_regionkey", "cascade"), ("customer", "n_nationkey", "nation", "n_nationkey", "cascade"),
    ("orders", "c_custkey", "customer", "c_custkey", "cascade"), ("lineitem", "o_orderkey", "orders", "o_orderkey", "cascade"), ("supplier", "n_nationkey", "nation", "n_nationkey", "set_null"),
]


def _chain(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    keys = {"nation": {"n_regionkey": "r_regionkey"}, "customer": {"c_nationkey": "n_nationkey"}, "orders": {"o_custkey": "c_custkey"}, "lineitem": {"l_orderkey": "o_orderkey"}, "supplier": {"s_nationkey": "n_nationkey"}}
    return {n: table(spark, sf_dir, n).withColumnsRenamed(keys.get(n, {})) for n in ("region", "nation", "customer", "orders", "lineitem", "supplier")}


@query("""
WITH n AS (SELECT n_nationkey, n_regionkey = 1 AS gone FROM nation), c AS (SELECT c_custkey, coalesce(gone, false) AS gone FROM customer LEFT JOIN n ON c_nationkey = n_nationkey),
o AS (SELECT o_orderkey, coalesce(gone, false) AS gone FROM orders LEFT JOIN c ON o_custkey = c_custkey), l AS (SELECT coalesce(gone, false) AS gone FROM lineitem LEFT JOIN o ON l_orderkey = o_orderkey)
SELECT table_name, count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS deleted FROM (
  SELECT 'region' AS table_name, r_regionkey = 1 AS gone FROM region UNION ALL SELECT 'nation', gone FROM n UNION ALL SELECT 'customer', gone FROM c UNION ALL SELECT 'orders', gone FROM o
  UNION ALL SELECT 'lineitem', gone FROM l UNION ALL SELECT 'supplier', false FROM supplier) GROUP BY ALL""")
def jn10_cascade_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _chain(spark, sf_dir)
    return lifecycle.cascade_purge(tables, _CHAIN, "region", tables["region"].filter("r_regionkey = 1").select("r_regionkey"))[1]


@query("SELECT s_suppkey, CASE WHEN n_regionkey <> 1 THEN s_nationkey END AS n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def jn10_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _chain(spark, sf_dir)
    kept, _ = lifecycle.cascade_purge(tables, _CHAIN, "region", tables["region"].filter("r_regionkey = 1").select("r_regionkey"))
    return kept["supplier"].select("s_suppkey", "n_nationkey")


@query("""
SELECT source_id, status, deleted FROM (
  SELECT c_custkey AS source_id, CASE WHEN c_custkey = 7 THEN 'purged' ELSE 'active' END AS status, CASE WHEN c_custkey = 7 THEN (SELECT count(*) FROM orders WHERE o_custkey = 7) END AS deleted FROM customer)""")
def d11_purge_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.lit("active").alias("status"))
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "source_id")
    marked, _, log = lifecycle.purge_source(sources, {"orders": orders}, [("orders", "source_id", "source", "source_id", "cascade")], 7, now())
    return marked.join(log.select(F.col("source_id").cast("long"), F.col("deleted_rows")["orders"].alias("deleted")), "source_id", "left")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey <> 9)")
def d11_deprecated_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("deprecated_at"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("source_id"))
    return lifecycle.visible(orders, lifecycle.deprecate_source(sources, 9, now())).select("o_orderkey")


# analytics


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS keep_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1")
def d2_content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.content_duplicates(table(spark, sf_dir, "documents"))


@query("SELECT entity, domain, count(*) AS mentions, count(DISTINCT document) AS documents FROM v_mentions WHERE domain = 'en' AND source_id <> 'src0' GROUP BY ALL")
def d3_mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = table(spark, sf_dir, "documents").filter("source = 'src0'").select(F.col("source").alias("source_id")).distinct()
    return analytics.mention_counts(views.v_entities(spark, sf_dir), "en", hidden=hidden)


@query("SELECT entity, domain, count(*) AS mentions, count(DISTINCT document) AS documents FROM v_mentions GROUP BY ALL")
def d3_mention_counts_cross_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.mention_counts(views.v_entities(spark, sf_dir), cross_domain=True)


@query("""
WITH c AS (SELECT entity, domain, epoch(date_trunc('week', published_at))::BIGINT AS bucket, count(*) AS mentions FROM v_mentions WHERE precision IN ('exact', 'date') GROUP BY ALL)
SELECT *, mentions - lag(mentions) OVER (PARTITION BY entity, domain ORDER BY bucket) AS change FROM c""")
def d4_term_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.term_velocity(views.v_mentions(spark, sf_dir)).withColumn("bucket", F.unix_timestamp("bucket"))


def _maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mention counts after three batches, between which one source is hidden and restored, another hidden, and a third purged."""
    path, rows = fresh_folder(spark, "mention-counts"), views.v_entities(spark, sf_dir)
    for third in range(3):
        mentions.add_batch(rows.filter(F.col("document") % 3 == third), path, 10 * third)
        if third == 0:
            mentions.retract(spark, path, 1, ["src3"])
            mentions.restore(spark, path, 2, 1)
    mentions.retract(spark, path, 21, ["src0"])
    mentions.retract(spark, path, 22, ["src1", "src5"])
    mentions.retract(spark, path, 22, ["src1", "src5"])  # a step that runs again
    return mentions.current(spark, path)


@query("SELECT entity, domain, count(*) AS mentions, count(DISTINCT document) AS documents FROM v_mentions WHERE source_id NOT IN ('src0', 'src1', 'src5') GROUP BY ALL")
def d3_mention_counts_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.counts(_maintained(spark, sf_dir))


@query("""
WITH c AS (SELECT entity, domain, epoch(date_trunc('week', published_at))::BIGINT AS bucket, count(*) AS mentions FROM v_mentions WHERE precision IN ('exact', 'date') AND source_id NOT IN ('src0', 'src1', 'src5') GROUP BY ALL)
SELECT *, mentions - lag(mentions) OVER (PARTITION BY entity, domain ORDER BY bucket) AS change FROM c""")
def d4_term_velocity_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.velocity(_maintained(spark, sf_dir)).withColumn("bucket", F.unix_timestamp("bucket"))


@query("""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(q, embedding::DOUBLE[]) AS score FROM q CROSS JOIN embeddings)
SELECT query_id, vec_id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def d5_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    found = analytics.vector_topk(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), v.select("vec_id", F.col("embedding").alias("v")), 5)
    return found.withColumn("score", F.round("score", 6))


@query(SQL["d5_vector_topk"])
def d5_vector_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over cells, leaving out those that cannot reach the k-th best."""
    v = table(spark, sf_dir, "embeddings")
    cells = analytics.vector_cells(v.select("vec_id", F.col("embedding").alias("v")))
    found, _ = analytics.pruned_topk(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), cells, 5)
    return found.withColumn("score", F.round("score", 6))


@query("""
WITH t AS (SELECT conv_id AS document, turn, role, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM conversations),
m AS (SELECT *, CASE WHEN lag(role) OVER o IS DISTINCT FROM role THEN 1 ELSE 0 END AS new FROM t WINDOW o AS (PARTITION BY document ORDER BY turn)),
i AS (SELECT *, sum(new) OVER (PARTITION BY document ORDER BY turn) AS island FROM m),
w AS (SELECT *, floor(coalesce(sum(tokens) OVER (PARTITION BY document, island ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 40) AS win FROM i),
c AS (SELECT document, island, win, min(role) AS speaker, min(turn) AS first_idx, max(turn) AS last_idx, sum(tokens)::BIGINT AS token_count, string_agg(text, ' ' ORDER BY turn) AS text, min(turn * 1000)::BIGINT AS start_ms, max(turn * 1000 + coalesce(length(text), 0))::BIGINT AS end_ms FROM w GROUP BY ALL)
SELECT document, speaker, first_idx, last_idx, token_count, text, start_ms, end_ms, (row_number() OVER (PARTITION BY document ORDER BY first_idx) - 1)::INT AS chunk FROM c""")
def d7_chunk_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), "text", (F.col("turn") * 1000).cast("long").alias("offset_ms"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("duration_ms"))
    return analytics.chunk_segments(c, 40)


@query("""
SELECT entity, epoch(a)::BIGINT AS first_a, epoch(b)::BIGINT AS first_b
FROM (SELECT entity, min(published_at) FILTER (domain = 'en') AS a, min(published_at) FILTER (domain = 'de') AS b FROM v_mentions GROUP BY entity) WHERE a < b""")
def d8_crossed_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = analytics.crossed_over(views.v_mentions(spark, sf_dir), "en", "de")
    return seen.select("entity", F.unix_timestamp("first_a").alias("first_a"), F.unix_timestamp("first_b").alias("first_b"))


@query("""
WITH e AS (SELECT DISTINCT user_id AS tenant_id, flow_name FROM events CROSS JOIN (VALUES ('click'), ('never')) f(flow_name)),
h AS (SELECT user_id AS tenant_id, event_type AS flow_name, max(ts) AS last FROM events GROUP BY ALL)
SELECT tenant_id, flow_name, last IS NULL AS never_run FROM e LEFT JOIN h USING (tenant_id, flow_name) WHERE last IS NULL OR last < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 48 HOURS""")
def d10_stale_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    expected = e.select(F.col("user_id").alias("tenant_id"), F.explode(F.array(F.lit("click"), F.lit("never"))).alias("flow_name")).distinct()
    beats = e.select(F.col("user_id").alias("tenant_id"), F.col("event_type").alias("flow_name"), F.col("ts").cast("timestamp").alias("last_success_at"))
    return analytics.stale_flows(expected, beats, F.lit("2024-01-30 00:00:00").cast("timestamp"), 48).select("tenant_id", "flow_name", "never_run")


@query("""
WITH g AS (SELECT name, unnest(list_distinct(list_transform(range(1, length('  ' || lower(name) || ' ') - 1), lambda i: substr('  ' || lower(name) || ' ', i, 3)))) AS gram FROM (SELECT DISTINCT p_name AS name FROM part)),
n AS (SELECT name, count(*) AS m FROM g GROUP BY name), c AS (SELECT a.name AS surface, b.name AS alias, count(*) AS c FROM g a JOIN g b USING (gram) GROUP BY ALL)
SELECT surface, alias, c::DOUBLE / (x.m + y.m - c) AS similarity FROM c JOIN n x ON x.name = surface JOIN n y ON y.name = alias WHERE c::DOUBLE / (x.m + y.m - c) >= 0.6""")
def d12_alias_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return analytics.alias_match(p.select(F.col("p_name").alias("surface")), p.select(F.col("p_name").alias("alias")), 0.6)


@query("""
SELECT c.conv_id || ':' || c.turn AS transcript_id, c.text, p.text AS parent_text FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 WHERE c.turn > 0""")
def d13_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    versions = c.select(F.concat_ws(":", "conv_id", "turn").alias("transcript_id"), F.when(F.col("turn") > 0, F.concat_ws(":", "conv_id", F.col("turn") - 1)).alias("derived_from_id"), "text")
    return analytics.lineage(versions).select("transcript_id", "text", "parent_text")


#: Versions: a chain of turns per conversation; every seventh conversation's first turn derives from its last (a cycle), every fifth one's from a version that is not there.
_VERSIONS = """
versions AS (
  SELECT conv_id || ':' || turn AS id, conv_id, turn, text, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) WHEN conv_id % 7 = 3 THEN conv_id || ':' || max(turn) OVER (PARTITION BY conv_id) WHEN conv_id % 5 = 1 THEN 'lost' END AS up
  FROM conversations)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    up = F.when(F.col("turn") > 0, F.concat_ws(":", "conv_id", F.col("turn") - 1)).when(F.col("conv_id") % 7 == 3, F.concat_ws(":", "conv_id", "last")).when(F.col("conv_id") % 5 == 1, F.lit("lost"))
    return c.join(last.hint("merge"), "conv_id").select(F.concat_ws(":", "conv_id", "turn").alias("transcript_version_id"), up.alias("derived_from_id"), "conv_id", "turn", "text")


@query(f"""
WITH RECURSIVE {_VERSIONS},
walk AS (
  SELECT id, id AS root, 0 AS depth FROM versions WHERE up IS NULL OR up NOT IN (SELECT id FROM versions)
  UNION ALL
  SELECT v.id, w.root, w.depth + 1 FROM walk w JOIN versions v ON v.up = w.id)
SELECT v.id AS transcript_version_id, root, depth::BIGINT AS depth FROM versions v LEFT JOIN walk w USING (id)""")
def d13_lineage_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.lineage_roots(_versions(spark, sf_dir), "transcript_version_id")


_MODEL_CASCADE: list[lifecycle.Reference] = [(child, column, parent, f"{parent}_id", action) for child, column, parent, action in REFERENCES if {child, parent} <= {"transcript_version", "segment", "chunk"}]


@query(f"""
WITH RECURSIVE {_VERSIONS},
gone AS (SELECT id FROM versions WHERE conv_id % 3 = 0 AND turn = 2 UNION SELECT v.id FROM gone g JOIN versions v ON v.up = g.id),
part AS (SELECT v.id, g.id IS NOT NULL AS gone, len(string_split(text, ' ')) AS words FROM versions v LEFT JOIN gone g USING (id))
SELECT 'transcript_version' AS table_name, count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS deleted, 0 AS dangling FROM part
UNION ALL SELECT 'segment', coalesce(sum(words) FILTER (NOT gone), 0)::BIGINT, coalesce(sum(words) FILTER (gone), 0)::BIGINT, 0 FROM part
UNION ALL SELECT 'chunk', count(*) FILTER (NOT gone), count(*) FILTER (gone), 0 FROM part""")
def jn10_self_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions go with the versions they derive from, through chains and cycles, and take segments and chunks along; dangling counts references into what went."""
    versions = _versions(spark, sf_dir)
    segments = versions.select("transcript_version_id", F.posexplode(F.split("text", " ")).alias("idx", "text"))
    tables = {"transcript_version": versions, "segment": segments, "chunk": versions.select("transcript_version_id", F.lit(0).alias("idx"))}
    doomed = versions.filter("conv_id % 3 = 0 and turn = 2").select("transcript_version_id")
    kept, counts = lifecycle.cascade_purge(tables, _MODEL_CASCADE, "transcript_version", doomed)
    went = versions.join(kept["transcript_version"].select("transcript_version_id").hint("merge"), "transcript_version_id", "left_anti").select(F.col("transcript_version_id").alias("ref"))
    refs = [kept[child].select(F.lit(child).alias("table_name"), F.col(column).alias("ref")) for child, column, *_ in _MODEL_CASCADE]
    dangling = reduce(DataFrame.union, refs).join(went.hint("merge"), "ref").groupBy("table_name").agg(F.count(F.lit(1)).alias("dangling"))
    return counts.join(dangling.hint("merge"), "table_name", "left").select("table_name", "kept", "deleted", F.coalesce("dangling", F.lit(0)).alias("dangling"))


# streaming folds, in batch


@query("""
WITH e AS (SELECT user_id AS run_id, event_id AS seq, ['discovered', 'fetching', 'fetched', 'skipped', 'failed', 'run_complete'][event_id % 6 + 1] AS kind, floor(value)::BIGINT AS v, event_type AS detail FROM events)
SELECT run_id, arg_max(v, seq) FILTER (kind = 'discovered') AS total, arg_max(v, seq) FILTER (kind IN ('fetching', 'fetched', 'skipped', 'failed')) AS current, count(*) FILTER (kind = 'fetched') AS fetched,
       count(*) FILTER (kind = 'skipped') AS skipped, count(*) FILTER (kind = 'failed') AS failed, arg_max(detail, seq) FILTER (kind <> 'skipped') AS detail, arg_max(detail, seq) FILTER (kind = 'run_complete') AS status,
       arg_max(v, seq) FILTER (kind = 'run_complete') AS credits FROM e GROUP BY run_id""")
def st2_run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [F.lit(x) for x in ("discovered", "fetching", "fetched", "skipped", "failed", "run_complete")]
    v = F.floor("value")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.element_at(F.array(*kinds), (F.col("event_id") % 6 + 1).cast("int")).alias("kind"),
        v.alias("current"), v.alias("total"), v.alias("credits"), F.col("event_type").alias("detail"), F.col("event_type").alias("status"),
    )
    return jobs.run_progress(e)


@query("SELECT event_id FROM (SELECT event_id, ['web', 'rss', 'arxiv', 'podcast'][event_id % 4 + 1] AS kind FROM events) WHERE kind = 'podcast'")
def ck2_source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("web", "rss", "arxiv", "podcast")]), (F.col("event_id") % 4 + 1).cast("int"))
    return quality.enum_violations(table(spark, sf_dir, "events").select("event_id", kind.alias("kind")), {"kind": ENUMS["source_kind"]}).select("event_id")


# jobs that write


@query("SELECT page_id, i AS pos, ref FROM (SELECT page_id, unnest([url, NULL, 'h' || page_id]) AS ref, unnest([0, 1, 2]) AS i FROM pages WHERE page_id % 3 < 2) WHERE ref IS NOT NULL")
def src3_intake_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.parse_intake(_intake_files(spark, sf_dir))[0].select(F.col("path").cast("long").alias("page_id"), "pos", "ref")


@query("SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 1 END AS pos, CASE WHEN page_id % 3 < 2 THEN 'no url, handle or channel' ELSE 'no list of channels' END AS error FROM pages")
def src3_intake_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.parse_intake(_intake_files(spark, sf_dir))[1].select(F.col("path").cast("long").alias("page_id"), "pos", "error")


def _intake_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dropped file per page: a list, an object with channels, or neither."""
    p = table(spark, sf_dir, "pages")
    listed = F.array(F.to_json(F.struct("url")), F.lit('{"nothing": 1}'), F.to_json(F.struct(F.lit("").alias("url"), F.concat(F.lit("h"), F.col("page_id")).alias("handle"))))
    array = F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]"))
    shapes = F.array(array, F.concat(F.lit('{"channels": '), array, F.lit("}")), F.lit('{"other": 1}'))
    return p.select(F.col("page_id").cast("string").alias("path"), F.lit(0).alias("mtime"), F.element_at(shapes, (F.col("page_id") % 3 + 1).cast("int")).alias("value"))


@query("SELECT provider, count(*) AS n, sum(credits)::BIGINT AS credits FROM v_usage GROUP BY ALL")
def snk4_usage_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, events = fresh_folder(spark, "usage"), views.v_usage(spark, sf_dir)
    usage.append_usage(events.filter("event_id % 5 < 2"), path)
    usage.append_usage(events.filter("event_id % 5 >= 2"), path)
    return spark.read.parquet(path).groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.sum("credits").alias("credits"))


@query("SELECT vec_id, label FROM embeddings WHERE label % 2 = 1")
def d6_version_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, vectors = fresh_folder(spark, "versions"), table(spark, sf_dir, "embeddings")
    for version in (0, 1):
        analytics.swap_version(vectors.filter(F.col("label") % 2 == version), path, f"m{version}")
    return analytics.active_vectors(spark, path).select("vec_id", "label")


@query("""
SELECT 'documents' AS dataset, count(*) AS n FROM documents UNION ALL SELECT 'bronze', count(*) FROM documents
UNION ALL SELECT 'transcripts', count(*) FROM documents WHERE doc_id % 4 <> 2
UNION ALL SELECT 'segments', (SELECT count(*) FROM v_segments WHERE item % 4 = 0) + (SELECT count(*) FROM documents WHERE doc_id % 4 = 1)""")
def st4_ingest_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping batches and a replay leave every item once."""
    path = fresh_folder(spark, "lake")
    more = [F.lit("native").alias("provider"), F.lit("transcript").alias("endpoint"), F.col("lang").alias("tenant_id"), F.col("source").alias("source_id"), "lang", F.lit(1).cast("long").alias("fetched_at")]
    raw = _segment_payloads(spark, sf_dir, *more).select("provider", "endpoint", "tenant_id", "source_id", "external_id", "lang", "fetched_at", "payload", "doc_id")
    for part in ("doc_id % 6 < 3", "doc_id % 6 >= 2", "doc_id % 6 < 3"):
        jobs.ingest_batch(raw.filter(part).drop("doc_id"), path)
    silver = lake.read_silver(spark, path)
    tables = {"documents": silver.documents, "bronze": lake.read_archive(spark, path, bronze.bronze_records(raw.drop("doc_id")).schema), "transcripts": silver.transcripts, "segments": silver.segments}
    parts = [rows.select(F.lit(n).alias("dataset")) for n, rows in tables.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE ordered AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY event_id) AS k FROM v_requests),
fold AS (
  SELECT tenant_id, k, event_id, cost <= 60 AS admitted, CASE WHEN cost <= 60 THEN cost ELSE 0 END AS spent FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.tenant_id, o.k, o.event_id, f.spent + o.cost <= 60, CASE WHEN f.spent + o.cost <= 60 THEN f.spent + o.cost ELSE f.spent END
  FROM fold f JOIN ordered o ON o.tenant_id = f.tenant_id AND o.k = f.k + 1)
SELECT tenant_id, event_id AS position, admitted FROM fold""")
def st3_admission_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over the events table, run until its input is used up."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("maxBytesPerTrigger", str(1 << 30)).parquet(f"{sf_dir}/events.parque[t]")
    requests = stream.select(F.col("user_id").alias("tenant_id"), F.col("event_id").alias("position"), (1 + F.col("event_id") % 5).alias("cost"))
    return _run_admission(spark, jobs.admit_stream(requests, 60), fresh_folder(spark, "admitted")).select("tenant_id", "position", "admitted")


def _run_admission(spark: SparkSession, admitted: DataFrame, path: str) -> DataFrame:
    """What the stream has written to ``path`` when its input is used up."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    writer = admitted.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer.start(path).awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(path)


@query("""
WITH RECURSIVE ordered AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY event_id) AS k FROM v_requests),
fold AS (
  SELECT tenant_id, k, cost <= 60 AS admitted, CASE WHEN cost <= 60 THEN cost ELSE 0 END AS spent FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.tenant_id, o.k, f.spent + o.cost <= 60, CASE WHEN f.spent + o.cost <= 60 THEN f.spent + o.cost ELSE f.spent END
  FROM fold f JOIN ordered o ON o.tenant_id = f.tenant_id AND o.k = f.k + 1)
SELECT tenant_id, k AS position, admitted FROM fold""")
def st3_admission_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests numbered per tenant arrive in three runs of the stream, the first ones last: the result is that of the right order."""
    path, out, place = fresh_folder(spark, "requests"), fresh_folder(spark, "admitted"), F.row_number().over(Window.partitionBy("tenant_id").orderBy("event_id"))
    numbered = views.v_requests(spark, sf_dir).select("tenant_id", place.cast("long").alias("position"), "cost", F.col("ts").cast("timestamp").alias("at"))
    numbered.write.parquet(f"{path}-all")
    numbered = spark.read.parquet(f"{path}-all")
    for third in (2, 1, 0):
        numbered.filter(F.col("position") % 3 == third).write.mode("append").parquet(path)
        stream = spark.readStream.schema(numbered.schema).option("maxBytesPerTrigger", str(1 << 30)).parquet(path).withWatermark("at", "3650 days")
        found = _run_admission(spark, jobs.admit_stream_ordered(stream, 60, first=1), out)
    return found.select("tenant_id", "position", "admitted")
