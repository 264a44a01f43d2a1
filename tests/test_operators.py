"""Rules and edge cases of the operators on small frames."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakescribe.functions import expr
from lakescribe.operators import analytics, ingest, lifecycle, mentions, normalize, quality, seeds, tenancy, usage
from lakescribe.sources import bronze, intake
from lakescribe.sources import seeds as seed_source


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_expressions(spark):
    df = spark.createDataFrame([("@@Foo", "CAP at 12 only", 1.36), ("bar", "no", 0.0005), (None, None, None)], "h string, note string, s double")
    got = df.select(expr.bare_handle(F.col("h")), expr.at_handle(F.col("h")), expr.cap_of(F.col("note")), expr.ms_of(F.col("s")), expr.base_language(F.lit("en-US"))).collect()
    assert [tuple(r) for r in got] == [("foo", "@Foo", 12, 1360, "en"), ("bar", "@bar", None, 0, "en"), (None, None, None, None, "en")]
    assert spark.range(1).select(expr.canonical_json(F.lit('{"b":1,"a":{"d":2,"c":3}}'))).first()[0] == '{"a":{"c":3,"d":2},"b":1}'
    assert spark.range(1).select(expr.canonical_json(F.lit("oops"))).first()[0] is None


CASES = [
    ("preferred succeeds", "AB", {"A": "ok"}, ("A", None, 1)),
    ("blocked falls through", "AB", {"A": "blocked", "B": "ok"}, ("B", None, 2)),
    ("unavailable stops", "AB", {"A": "unavailable", "B": "ok"}, (None, "transcript-unavailable", 1)),
    ("all blocked", "AB", {"A": "blocked", "B": "blocked"}, (None, "provider-blocked", 2)),
    ("reversed order", "BA", {"A": "ok", "B": "ok"}, ("B", None, 1)),
    ("invalid stops", "AB", {"A": "invalid", "B": "ok"}, (None, "invalid-request", 1)),
    ("other error, then blocked", "AB", {"A": "error", "B": "blocked"}, (None, "provider-blocked", 2)),
    ("not configured", "A", {"B": "ok"}, (None, "no-provider-available", 0)),
]


@pytest.mark.parametrize("name, order, outcomes, want", CASES)
def test_failover(spark, name, order, outcomes, want):
    df = spark.createDataFrame([("x", p, o) for p, o in outcomes.items()], "item string, provider string, outcome string")
    r = ingest.resolve_attempts(df, list(order)).first()
    assert (r.chosen_provider, r.error, r.attempts_made) == want


def test_unknown_provider_is_an_error():
    with pytest.raises(ValueError):
        ingest.check_order(["A", "X"], ["A", "B"])


def payloads(spark, *values):
    return spark.createDataFrame([(str(i), json.dumps(v) if not isinstance(v, str) else v) for i, v in enumerate(values)], "external_id string, payload string")


def test_segments_of_both_providers_agree(spark):
    ms = normalize.normalize_segments_ms(payloads(spark, {"lang": "en", "content": [{"lang": "en", "text": "hi", "offset": 1360, "duration": 1680}]}))[0].first()
    s = normalize.normalize_segments_s(payloads(spark, {"snippets": [{"text": "hi", "start": 1.36, "duration": 1.68}]}))[0].first()
    assert [tuple(x) for x in ms.segments] == [tuple(x) for x in s.segments] == [(0, "hi", 1360, 1680)]


def test_segments_ms_edges(spark):
    df = payloads(spark, {"content": [{"text": "a", "offset": 1.9}]}, {"content": "all"}, {"content": None}, {"content": []}, {"content": [{"text": "a"}]}, {"content": [{"offset": 1}]}, "no json", {"content": [{"text": "late", "offset": 181896, "duration": 5}]})
    items, rejects = normalize.normalize_segments_ms(df)
    got = {r.external_id: r.segments and [tuple(s) for s in r.segments] for r in items.collect()}
    assert got == {"0": [(0, "a", 1, 0)], "1": [(0, "all", 0, 0)], "2": None, "3": [], "6": None, "7": [(0, "late", 181896, 5)]}
    assert {r.external_id for r in rejects.collect()} == {"4", "5"}


def test_metadata_edges(spark):
    got = normalize.normalize_metadata(payloads(spark, {"timestamp": 86400, "upload_date": "20250403", "id": "v"}, {"timestamp": 0, "upload_date": "20250403"}, {"upload_date": "2025"}, {"automatic_captions": {"fr": [], "de": []}})).collect()
    assert [(r.item_id, r.published_at and r.published_at.isoformat(), r.precision, r.date_source) for r in got] == [
        ("v", "1970-01-02T00:00:00", "exact", "api"), ("1", "2025-04-03T00:00:00", "date", "api"), ("2", None, "unknown", None), ("3", None, "unknown", None)]
    assert got[3].caption_langs == ["de", "fr"] and got[3].subtitle_langs is None
    api = normalize.normalize_metadata_api(payloads(spark, {"uploadDate": "2025-04-03T10:00:00.000Z", "tags": ["a"], "channel": {"id": "c"}}, {"uploadDate": "x"}, {})).collect()
    assert [(r.published_at and r.published_at.hour, r.precision) for r in api] == [(10, "exact"), (None, "unknown"), (None, "unknown")]
    assert api[0].extra.channel_id == "c" and api[0].extra.tags == ["a"]


def test_provenance(spark):
    df = spark.createDataFrame([("s", False, 200), ("ms", None, 202), ("ms", None, 200)], "provider_unit string, is_generated boolean, http_status int")
    got = normalize.assign_provenance(df)
    assert [(r.is_auto_generated, r.provenance_confidence) for r in got.collect()] == [(False, "known"), (True, "inferred"), (None, "unknown")]
    assert quality.provenance_violations(got).count() == 0


def test_bronze_is_write_once(spark, tmp_path):
    def record(i, payload, at):
        return ("p", "e", str(i), at, payload)

    schema = "provider string, endpoint string, external_id string, fetched_at long, payload string"
    held = bronze.bronze_records(spark.createDataFrame([record(1, '{"a":1,"b":2}', 5)], schema))
    incoming = bronze.bronze_records(spark.createDataFrame([record(1, '{"b":2,"a":1}', 5), record(1, '{"a":1,"b":2}', 6), record(2, "x", 1), record(2, "x", 1), record(2, "x", 2)], schema))
    parts = bronze.bronze_append(incoming, held)
    assert [df.count() for df in parts] == [1, 1, 2]
    assert [df.count() for df in bronze.bronze_append(incoming, held, "keep_first")] == [1, 3, 0]
    assert bronze.bronze_exists(incoming, held).count() == 2
    bronze.write_bronze(held.union(parts.new), str(tmp_path / "b"))
    assert bronze.read_bronze(spark, str(tmp_path / "b"), "p").count() == 2
    assert bronze.read_bronze(spark, str(tmp_path / "b"), "q").count() == 0
    assert bronze.read_bronze(spark, str(tmp_path / "b"), keys=held.select("key")).count() == 1


def test_budget_admission_is_greedy(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 6, 3, 1])] + [(2, 0, 99), (2, 1, 9)], "tenant_id long, position long, cost long")
    got = {(r.tenant_id, r.position): r.admitted for r in usage.admit(df, 9).collect()}
    assert got == {(1, 0): True, (1, 1): False, (1, 2): True, (1, 3): True, (2, 0): False, (2, 1): True}


def test_usage_summary_has_zeros(spark):
    events = spark.createDataFrame([(1, "a", 4, "2024-02-20 01:00:00"), (1, "a", 2, "2024-02-01 00:00:00"), (1, "a", 1, "2024-01-21 12:00:00"), (1, "a", 8, "2023-01-01 00:00:00")], "tenant_id long, provider string, credits long, occurred_at string")
    events = events.withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    keys = spark.createDataFrame([(1, "a"), (1, "b")], "tenant_id long, provider string")
    got = {r.provider: (r.today, r.month, r.last_30d, r.avg_per_day, r.has_data) for r in usage.usage_summary(events, F.lit("2024-02-20 12:00:00").cast("timestamp"), keys).collect()}
    assert got == {"a": (4, 6, 7, 7 / 30, True), "b": (0, 0, 0, 0.0, False)}


def test_tenants_are_isolated(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, tenant_id string")
    assert rows(tenancy.tenant_view(df, "a")) == [(1, "a")]
    assert tenancy.tenant_view(df, None).count() == tenancy.tenant_view(df, "").count() == 0
    with pytest.raises(PermissionError):
        tenancy.tenant_write_check(df, "a")
    assert tenancy.tenant_write_check(df.filter("id = 1"), "a").count() == 1
    assert tenancy.tenant_violations(df, None).count() == 3
    assert {r.id for r in tenancy.tenant_delete(df, df.select("id"), "a", ["id"]).collect()} == {2, 3}
    plan = tenancy.tenant_view(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "de", "lang")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in plan


def test_malformed_tenant_fails(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tenancy.tenant_view(spark.range(3), "x", "id").collect()


def test_priority_merge(spark):
    a = spark.createDataFrame([("@Foo", 0, 1), ("x", 3, 2)], "handle string, videos int, position int")
    b = spark.createDataFrame([("foo", 7, 1), ("FOO", 8, 2), ("y", None, 3)], "handle string, videos int, position int")
    got = {r.handle: (r.from_list, r.videos, r.also_in) for r in seeds.priority_merge([("a", a), ("b", b)]).collect()}
    assert got == {"@Foo": ("a", 7, ["b", "b"]), "x": ("a", 3, []), "y": ("b", None, [])}


def test_classify_ref_order(spark):
    texts = [" https://youtube.com/@a?v=abcdefghijk ", "https://youtu.be/abcdefghijk", "shorts/abcdefghijk", "https://youtube.com/@some.one-x/videos", "@bare", "", None, "junk"]
    got = seeds.classify_ref(spark.createDataFrame([(t,) for t in texts], "raw string")).collect()
    assert [(r.kind, r.ref, r.error) for r in got] == [("video", "abcdefghijk", None)] * 3 + [("handle", "@some.one-x", None), ("handle", "@bare", None), (None, None, "empty"), (None, None, "empty"), (None, None, "unrecognized")]


def test_limit_zero_is_no_limit(spark):
    df = spark.createDataFrame([("s", i) for i in range(5)], "source_id string, position int")
    assert ingest.limit_per_source(df, 0).count() == ingest.limit_per_source(df).count() == 5
    assert ingest.limit_per_source(df, 2).count() == 2
    caps = spark.createDataFrame([("s", 3)], "source_id string, cap int")
    assert ingest.limit_per_source(df, 0, caps).count() == 3
    assert ingest.limit_per_source(df, 2, caps).count() == 2


def test_intake(spark, tmp_path):
    texts = {"a": ["@x", {"url": "", "handle": "h"}, {"nothing": 1}, 5, ""], "b": {"channels": [{"channel": "c"}]}, "c": {"no": 1}}
    for name, value in texts.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    (tmp_path / "d.json").write_text("{oops")
    (tmp_path / "e.txt").write_text("[]")
    good, bad = intake.read_intake(spark, str(tmp_path))
    assert sorted(r.ref for r in good.collect()) == ["@x", "c", "h"]
    assert sorted((r.path[-6:], r.pos) for r in bad.collect() if r.pos is not None) == [("a.json", 2), ("a.json", 3), ("a.json", 4)]
    assert sorted(r.path[-6:] for r in bad.collect() if r.pos is None) == ["c.json", "d.json"]
    ledger = good.select("path", "mtime").union(bad.select("path", "mtime")).distinct()
    again = intake.read_intake(spark, str(tmp_path), ledger)
    assert again[0].count() == again[1].count() == 0


def test_seed_files(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"handle":"@A","phase":"p"}\n{"handle":"b","phase":"q"}\n')
    assert seed_source.read_seeds(spark, str(tmp_path / "s.jsonl"), "p", "a").count() == 1
    assert seed_source.read_seeds(spark, str(tmp_path / "s.jsonl"), "q", "@a").count() == 0


def test_fan_out_is_deterministic(spark):
    df = spark.createDataFrame([("t", "s", "1", "p", "en", [(0, "a", 0, 0)]), ("t", "s", "2", "p", "en", None), ("t", "s", "3", "p", "en", [])], f"tenant_id string, source_id string, external_id string, provider string, lang string, segments {ingest.F and 'array<struct<idx:int,text:string,offset_ms:bigint,duration_ms:bigint>>'}")
    one, two = ingest.fan_out(df), ingest.fan_out(df.repartition(3))
    assert all(rows(a) == rows(b) for a, b in zip(one, two, strict=True))
    assert [x.count() for x in one] == [3, 2, 1]
    assert {r.external_id: r.status for r in one.documents.collect()} == {"1": "enriched", "2": "failed", "3": "enriched"}


def test_versions_swap(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    analytics.swap_version(v, str(tmp_path), "m1")
    analytics.swap_version(v.union(v), str(tmp_path), "m2")
    assert analytics.active_vectors(spark, str(tmp_path)).count() == 2
    assert spark.read.parquet(str(tmp_path / "vectors")).count() == 3


def test_purge_keeps_a_tombstone(spark):
    sources = spark.createDataFrame([(1, "active"), (2, "active")], "source_id int, status string")
    docs = spark.createDataFrame([(10, 1), (20, 2)], "document_id int, source_id int")
    mentions = spark.createDataFrame([(100, 10), (200, 20), (300, None)], "mention_id int, document_id int")
    references = [("docs", "source_id", "source", "source_id", "cascade"), ("mentions", "document_id", "docs", "document_id", "set_null")]
    marked, kept, log = lifecycle.purge_source(sources, {"docs": docs, "mentions": mentions}, references, 1, F.current_timestamp())
    assert rows(marked) == [(1, "purged"), (2, "active")]
    assert rows(kept["docs"].select("document_id")) == [(20,)]
    assert {r.mention_id: r.document_id for r in kept["mentions"].collect()} == {100: None, 200: 20, 300: None}
    assert log.first().deleted_rows == {"docs": 1, "mentions": 0}


def test_coarse_dates_do_not_count(spark):
    df = spark.createDataFrame([("a", "x", "2024-01-01", "exact"), ("a", "x", "2024-01-01", "month"), ("a", "x", None, "exact")], "entity string, domain string, at string, precision string").withColumn("published_at", F.col("at").cast("timestamp"))
    assert analytics.term_velocity(df).first().mentions == 1
    with pytest.raises(ValueError):
        analytics.mention_counts(df)


def test_empty_tables(spark):
    items = spark.createDataFrame([], "tenant_id string, source_id string, external_id string, position int")
    docs = spark.createDataFrame([], "tenant_id string, source_id string, external_id string, status string")
    assert ingest.new_items(items, docs).count() == 0
    assert quality.unique_violations(items, ["external_id"]).count() == 0
    assert analytics.alias_match(spark.createDataFrame([], "surface string"), spark.createDataFrame([], "alias string")).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_topk_in_blocks(spark, monkeypatch, parts):
    """More queries than one broadcast holds, one id among them twice, give the same rows as one block."""
    vectors = spark.range(60).select(F.col("id").alias("vec_id"), F.array(*[F.sin((F.col("id") + 1) * i).cast("float") for i in (1, 2, 3)]).alias("v"))
    queries = vectors.filter("vec_id < 23").union(vectors.filter("vec_id = 3")).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).repartition(parts)
    whole = rows(analytics.vector_topk(queries, vectors, 4))
    assert len(whole) == 23 * 4
    for block in (5, 8, 24):
        monkeypatch.setattr(analytics, "BROADCAST_QUERIES", block)
        assert rows(analytics.vector_topk(queries, vectors, 4)) == whole


def test_topk_ties_and_odd_vectors(spark):
    """Equal vectors tie by id over batches and tasks; vectors without a cosine are in no result."""
    table = [(i, [float(i % 7 - 3), 1.0, 0.1 * (i % 5)]) for i in range(400)] + [(900 + i, v) for i, v in enumerate([None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0]])]
    vectors = spark.createDataFrame(table, "vec_id long, v array<float>").repartition(5)
    queries = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [-1.0, 0.5, 0.0]), ("c", None), ("d", [2.0, 1.0]), ("e", [0.0, 0.0, 0.0])], "query_id string, q array<float>")

    def cos(a, b):
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        return a @ b / np.sqrt(a @ a * (b @ b))

    want = [(n, i) for n, q in (("a", [1, 2, 3]), ("b", [-1, 0.5, 0])) for _, i in sorted((-round(cos(q, v), 12), i) for i, v in table[:400])[:9]] + [("d", 904)]
    got = analytics.vector_topk(queries, vectors, 9).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == want
    assert analytics.vector_topk(queries, vectors.limit(0), 9).count() == 0
    assert analytics.vector_topk(queries.limit(0), vectors, 9).count() == 0


def test_purge_keeps_columns_and_clears_references(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a_id int, name string")
    b = spark.createDataFrame([(10, 1, None), (11, 2, 1), (12, None, 2), (12, None, 2)], "b_id int, a_id int, other int")
    refs = [("b", "a_id", "a", "a_id", "cascade"), ("b", "other", "a", "a_id", "set_null")]
    kept, counts = lifecycle.cascade_purge({"a": a, "b": b}, refs, "a", spark.createDataFrame([(1,), (1,)], "a_id int"))
    assert rows(kept["b"]) == [(11, 2, None), (12, None, 2), (12, None, 2)] and kept["b"].columns == b.columns
    assert rows(counts) == [("a", 1, 1), ("b", 3, 1)]


CHAIN = [("a0", None), *[(f"a{i}", f"a{i - 1}") for i in range(1, 12)], ("c1", "c3"), ("c2", "c1"), ("c3", "c2"), ("c4", "c2"), ("b", "lost"), ("b1", "b"), ("self", "self")]


def test_lineage_roots_of_chains_cycles_and_lost_parents(spark):
    got = {r.id: (r.root, r.depth) for r in analytics.lineage_roots(spark.createDataFrame(CHAIN, "id string, up string"), "id", "up").collect()}
    want = {f"a{i}": ("a0", i) for i in range(12)} | {f"c{i}": (None, None) for i in range(1, 5)} | {"b": ("b", 0), "b1": ("b", 1), "self": (None, None)}
    assert got == want
    assert analytics.lineage_roots(spark.createDataFrame([], "id string, up string"), "id", "up").count() == 0


@pytest.mark.parametrize("doomed, gone", [("a9", {"a9", "a10", "a11"}), ("a0", {f"a{i}" for i in range(12)}), ("c3", {"c1", "c2", "c3", "c4"}), ("b", {"b", "b1"}), ("self", {"self"}), ("none", set())])
def test_a_purge_follows_self_references(spark, doomed, gone):
    versions = spark.createDataFrame(CHAIN, "id string, up string")
    segments = spark.createDataFrame([(i, n) for i, _ in CHAIN for n in range(2)], "id string, n int")
    references = [("version", "up", "version", "id", "cascade"), ("segment", "id", "version", "id", "cascade")]
    kept, counts = lifecycle.cascade_purge({"version": versions, "segment": segments}, references, "version", spark.createDataFrame([(doomed,)], "id string"))
    assert {r.id for r in kept["version"].collect()} == {i for i, _ in CHAIN} - gone
    assert {r.table_name: (r.kept, r.deleted) for r in counts.collect()} == {"version": (len(CHAIN) - len(gone), len(gone)), "segment": (2 * (len(CHAIN) - len(gone)), 2 * len(gone))}


def test_self_references_may_be_cleared(spark):
    """Set-null within a table: direct children lose their parent, and stay; with a cascade from outside at the same time."""
    tables = {"doc": spark.createDataFrame([("d1",), ("d2",)], "doc string"), "version": spark.createDataFrame([("a", "d1", None), ("b", "d2", "a"), ("c", "d2", "b"), (None, "d2", "a")], "id string, doc string, up string")}
    references = [("version", "doc", "doc", "doc", "cascade"), ("version", "up", "version", "id", "set_null")]
    kept, _ = lifecycle.cascade_purge(tables, references, "doc", spark.createDataFrame([("d1",)], "doc string"))
    assert rows(kept["version"]) == [(None, "d2", None), ("b", "d2", None), ("c", "d2", "b")] or rows(kept["version"]) == sorted([("b", "d2", None), ("c", "d2", "b"), (None, "d2", None)], key=str)


def folded(requests, budget):
    spent, out = {}, []
    for tenant, position, cost in sorted(requests, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        fits = spent.get(tenant, 0) + cost <= budget
        spent[tenant] = spent.get(tenant, 0) + cost * fits
        out.append((tenant, position, cost, fits))
    return out


@pytest.mark.parametrize("budget, share", [(0, 0.5), (7, 0.5), (60, 0.5), (3000, 0.9), (3000, 0.0)])
def test_a_hot_tenant_is_split_over_tasks(spark, budget, share):
    import random

    rng = random.Random(budget)
    requests = [(None if rng.random() < 0.01 else 7 if rng.random() < share else rng.randrange(40), i, rng.choice([0, 1, 2, 5, 70])) for i in range(3000)]
    df = spark.createDataFrame(requests, "tenant_id long, position long, cost long").repartition(5)
    got = usage.admit(df, budget)
    assert sorted(map(tuple, got.select("tenant_id", "position", "cost", "admitted").collect()), key=str) == sorted(folded(requests, budget), key=str)


def test_no_task_reads_a_hot_tenant_whole(spark):
    """Ranges of a tenant with nearly all rows: every task of both folds sees a part."""
    df = spark.range(4000).select((F.col("id") < 20).cast("long").alias("tenant_id"), F.col("id").alias("position"), (F.col("id") % 3).alias("cost"))
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = usage.admit(df, 50)
        sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_a_stretch_maps_what_was_spent(spark):
    stretch, costs = usage._Stretch(30), [3, 7, 1, 0, 9, 31, 2] * 40
    for c in costs:
        stretch.add(c)
    want = []
    for start in range(31):
        spent = start
        for c in costs:
            spent += c if spent + c <= 30 else 0
        want.append(spent)
    assert stretch.map().tolist() == want


def test_model_rules_read_each_table_once(spark, tmp_path):
    """Keys and references of all tables share one shuffle of keys; NULL parts are exempt, and a table may refer to itself."""
    frames = {
        "document": ("document_id string, tenant_id string, source_id string, external_id string", [("d1", "t", "s", "x"), ("d2", "t", "s", "x"), ("d3", None, "s", "x"), ("d4", None, "s", "x")]),
        "transcript_version": ("transcript_version_id string, document_id string, derived_from_id string", [("v1", "d1", None), ("v2", "d9", "v1"), ("v3", "d9", "v8")]),
        "segment": ("transcript_version_id string, idx int", [("v1", 0), ("v1", 0), ("v1", 0), ("v7", 1), ("v7", 2), (None, 1)]),
    }
    for name, (shape, own) in frames.items():
        spark.createDataFrame(own, shape).write.parquet(str(tmp_path / name))
    found = quality.model_violations({name: spark.read.parquet(str(tmp_path / name)) for name in frames})
    assert {(r.table_name, r.rule): r.violations for r in found.collect()} == {
        ("document", "unique tenant_id,source_id,external_id"): 1, ("segment", "unique transcript_version_id,idx"): 1, ("transcript_version", "document_id in document"): 2,
        ("transcript_version", "derived_from_id in transcript_version"): 1, ("segment", "transcript_version_id in transcript_version"): 2,
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3


def test_limits_and_caps(spark):
    items = spark.createDataFrame([(s, i) for s in "abcd" for i in range(10)], "source_id string, position int")
    caps = spark.createDataFrame([("a", 3), ("b", 0), ("c", None), ("d", 8)], "source_id string, cap int")
    count = lambda df: {r["source_id"]: (r["n"], r["last"]) for r in df.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last")).collect()}
    assert count(ingest.limit_per_source(items, caps=caps)) == {"a": (3, 2), "b": (10, 9), "c": (10, 9), "d": (8, 7)}
    assert count(ingest.limit_per_source(items, 5, caps)) == {"a": (3, 2), "b": (5, 4), "c": (5, 4), "d": (5, 4)}
    assert count(ingest.limit_per_source(items, 5)) == {s: (5, 4) for s in "abcd"}
    assert count(ingest.limit_per_source(items)) == count(ingest.limit_per_source(items, 0, caps.filter("cap = 0"))) == {s: (10, 9) for s in "abcd"}
    assert ingest.limit_per_source(items, caps=caps).columns == items.columns
    assert "WindowGroupLimit" in ingest.limit_per_source(items, caps=caps)._jdf.queryExecution().executedPlan().toString()


def test_maintained_counts_equal_a_recount(spark, tmp_path):
    """Appends, a hide, its undoing and a purge, in that order, each once more after a break; entities that are gone have no row."""
    import random

    rng, path = random.Random(6), str(tmp_path / "counts")
    documents = [(d, rng.choice("ab"), f"s{d % 4}", d % 60, rng.choice(["exact", "date", "month"])) for d in range(80)]
    said = [(rng.choice("uvwx") if s != "s3" else "only3", d, domain, s, at, p) for d, domain, s, at, p in documents for _ in range(rng.randrange(4))]
    every = spark.createDataFrame(said, "entity string, document int, domain string, source_id string, at int, precision string").withColumn("published_at", F.timestamp_seconds(1_700_000_000 + F.col("at") * 86400))
    for step in (0, 1, 1):
        mentions.add_batch(every.filter(F.col("document") % 2 == step), path, step)
    mentions.retract(spark, path, 2, ["s1"])
    mentions.restore(spark, path, 3, 2)
    for _ in range(2):
        mentions.retract(spark, path, 4, ["s3", "s2"])
    left = every.filter("source_id in ('s0', 's1')")
    now = mentions.current(spark, path)
    assert rows(mentions.counts(now)) == rows(analytics.mention_counts(left, cross_domain=True)) and "only3" not in str(rows(mentions.counts(now)))
    assert rows(mentions.counts(now, "a")) == rows(analytics.mention_counts(left, "a"))
    assert rows(mentions.velocity(now)) == rows(analytics.term_velocity(left))
    plan = spark._jvm.PythonSQLUtils.explainString(mentions.current(spark, path, 9, ["s1"])._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [In(source_id" in plan or "EqualTo(source_id,s1)" in plan


@pytest.mark.parametrize("clustered", [True, False])
def test_pruned_topk_equals_all_vectors(spark, clustered):
    """The same rows as scoring all; on clustered data under half of the pairs are scored. Ties, odd vectors and few vectors too."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    points = [centres[i % 20] + rng.normal(size=8) * 0.05 if clustered else rng.normal(size=8) for i in range(1500)]
    vectors = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    vectors += [(2000 + i, vectors[7][1]) for i in range(30)] + [(3000, None), (3001, [0.0] * 8), (3002, [1.0, None] + [0.0] * 6), (3003, [1.0, 2.0]), (3004, [-x for x in vectors[7][1]])]
    v = spark.createDataFrame(vectors, "vec_id long, v array<double>").repartition(4)
    queries = v.filter("vec_id % 50 = 0 or vec_id > 2998").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).filter("size(q) <> 2")
    got, share = analytics.pruned_topk(queries, analytics.vector_cells(v, 40), 5)
    assert rows(got.select("query_id", "rank", "vec_id", "score")) == rows(analytics.vector_topk(queries, v, 5).select("query_id", "rank", "vec_id", "score"))
    assert 0 < share < 0.5 if clustered else 0 < share <= 1
    few, _ = analytics.pruned_topk(queries, analytics.vector_cells(v.filter("vec_id < 3"), 40), 5)
    assert rows(few.select("query_id", "rank", "vec_id")) == rows(analytics.vector_topk(queries, v.filter("vec_id < 3"), 5).select("query_id", "rank", "vec_id"))
    assert analytics.pruned_topk(queries.limit(0), analytics.vector_cells(v, 4), 5)[0].count() == 0
    assert analytics.pruned_topk(queries.limit(0), analytics.vector_cells(v.limit(0), 4), 5)[0].count() == 0


@pytest.mark.parametrize("twice", [False, True])
def test_counts_of_whole_documents(spark, tmp_path, twice):
    """Rows a document give what rows a mention give, without a shuffle by document; a document in several rows is counted once."""
    words = [(d, ["a", "b", "a", None][: d % 5] if d else None, "xy"[d % 2], f"s{d % 3}", d) for d in range(30)]
    words += [(4, ["a", "c"], "x", "s1", 4)] if twice else []
    whole = spark.createDataFrame(words, "document int, entities array<string>, domain string, source_id string, at int").withColumns({"published_at": F.timestamp_seconds(1_700_000_000 + F.col("at") * 86400), "precision": F.lit("date")})
    single, hidden = analytics.expanded(whole), whole.select("source_id").filter("source_id = 's0'")
    got = analytics.mention_counts(whole, "x", hidden=hidden)
    key = lambda df: sorted(map(str, rows(df.select(sorted(df.columns)))))
    assert key(got) == key(analytics.mention_counts(single, "x", hidden=hidden)) and key(mentions.counted(whole)) == key(mentions.counted(single))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and (twice or plan.count("Exchange hashpartitioning(entity") == 1)
