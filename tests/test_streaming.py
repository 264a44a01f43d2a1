"""Streams against their batch twins."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lakescribe.operators import analytics, ingest, usage
from lakescribe.sources import dropped, intake, lake
from lakescribe.streaming import jobs


def test_run_progress_stream(spark, tmp_path):
    kinds = ["discovered", "fetching", "fetched", "skipped", "failed", "run_complete"]
    events = [(i % 3, i, kinds[i % 6], i, 100 + i, f"d{i}", "done", i * 2) for i in range(60)]
    df = spark.createDataFrame(events, "run_id int, seq int, kind string, current int, total int, detail string, status string, credits int")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.run_progress(stream).writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(map(tuple, spark.table("progress").collect())) == sorted(map(tuple, jobs.run_progress(df).collect()))


def test_admission_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        df = spark.createDataFrame([(t, i, (i * 7 + t) % 5 + 1) for t in range(3) for i in range(20)], "tenant_id long, position long, cost long")
        for part in range(2):
            df.filter(F.floor(F.col("position") / 10) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = jobs.admit_stream(stream, 25).writeStream.outputMode("append").format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table("admitted").collect())) == sorted(map(tuple, usage.admit(df, 25).select("tenant_id", "position", "cost", "admitted").collect()))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_admission_in_any_order(spark, tmp_path):
    """Rows come in reversed order, in three runs; the gap that a missing one leaves is given up when the watermark has passed it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, schema = str(tmp_path / "in"), "tenant_id long, position long, cost long, at timestamp"

    def run(rows):
        timed = spark.createDataFrame(rows, "tenant_id long, position long, cost long").withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("position")))
        timed.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("at", "1 hour")
        admitted = jobs.admit_stream_ordered(stream, 25, patience_ms=60_000)
        query = admitted.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(60)
        return sorted(map(tuple, spark.read.schema("tenant_id long, position long, cost long, admitted boolean").parquet(str(tmp_path / "out")).collect()))

    try:
        rows = [(t, i, (i * 7 + t) % 5 + 1) for t in range(3) for i in range(20)]
        lost = (2, 3)
        for third in (2, 1):
            assert run([r for r in rows if r[1] % 3 == third]) == []
        want = sorted(map(tuple, usage.admit(spark.createDataFrame(rows, "tenant_id long, position long, cost long"), 25).select("tenant_id", "position", "cost", "admitted").collect()))
        got = run([r for r in rows if r[1] % 3 == 0 and r[:2] != lost])
        assert [r for r in got if r[0] < 2] == [r for r in want if r[0] < 2] and [r[1] for r in got if r[0] == 2] == [0, 1, 2]
        got = run([(7, 0, 1), (7, 20_000, 1)])
        assert [r[1] for r in got if r[0] == 2] == [0, 1, 2, *range(4, 20)]
        assert sum(c for t, _, c, ok in got if t == 2 and ok) <= 25
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


RAW = "provider string, endpoint string, tenant_id string, source_id string, external_id string, lang string, fetched_at long, payload string"


def raw(spark, *ids):
    return spark.createDataFrame([("supadata", "transcript", "t", "s", str(i), "en", 1, json.dumps({"content": [{"text": f"x{i}", "offset": 0}]} if i % 2 else {"content": None})) for i in ids], RAW)


def counts(spark, path):
    silver = lake.read_silver(spark, path)
    return [archived(spark, path).count(), silver.documents.count(), silver.transcripts.count(), silver.segments.count()]


def archived(spark, path):
    return lake.read_archive(spark, path, spark.createDataFrame([], RAW + ", http_status int, is_generated boolean, available_langs array<string>, key string, record_hash string").schema)


def test_ingest_twice_is_once(spark, tmp_path):
    path = str(tmp_path / "lake")
    jobs.ingest_batch(raw(spark, 1, 2, 3), path)
    assert counts(spark, path) == [3, 3, 2, 2]
    jobs.ingest_batch(raw(spark, 1, 2, 3), path)
    assert counts(spark, path) == [3, 3, 2, 2]
    jobs.ingest_batch(raw(spark, 3, 4, 5, 5), path)
    assert counts(spark, path) == [5, 5, 3, 3]


def test_a_run_that_broke_off_is_made_good(spark, tmp_path, monkeypatch):
    """Broken off before the documents are written, then run again: every row is there once."""
    path = str(tmp_path / "lake")
    break_off(monkeypatch, "documents")
    with pytest.raises(Exception, match="gone"):
        jobs.ingest_batch(raw(spark, 1, 2, 3), path)
    monkeypatch.undo()
    assert counts(spark, path) == [3, 0, 0, 0]  # archived, but none of the three tables shows
    jobs.ingest_batch(raw(spark, 1, 2, 3), path)
    assert counts(spark, path) == [3, 3, 2, 2]


def break_off(monkeypatch, table):
    write = lake.write_run

    def broken(rows, now, name, run):
        write(rows.select(F.raise_error(F.lit("gone")).cast("string").alias("external_id")) if name == table else rows, now, name, run)

    monkeypatch.setattr(lake, "write_run", broken)


def responses(spark, *records):
    """(item, provider, payload, status)"""
    rows = [(p, "metadata" if p == "ytdlp" else "transcript", "t", "s", item, "en", 1, json.dumps(payload), status) for item, p, payload, status in records]
    return spark.createDataFrame(rows, RAW + ", http_status int")


SAYS, SNIPPETS = {"content": [{"text": "one", "offset": 0}]}, {"snippets": [{"text": "two", "start": 1.0}]}
ANSWERS = [
    ("late", "supadata", {}, 429), ("late", "ytapi", SNIPPETS, 200), ("late", "ytdlp", {"id": "late", "title": "T"}, 200),
    ("better", "supadata", SAYS, 200), ("better", "ytapi", SNIPPETS, 200), ("gone", "supadata", {}, 404), ("gone", "ytapi", SNIPPETS, 200), ("other", "supadata", SAYS, 200),
]


def shown(silver):
    return [sorted(map(str, (r.asDict() for r in t.select(sorted(t.columns)).collect()))) for t in silver]


@pytest.mark.parametrize("order, breaks", [(("supadata", "ytapi", "ytdlp"), "documents"), (("ytdlp", "ytapi", "supadata"), "bronze")])
def test_late_answers_equal_a_rebuild(spark, tmp_path, monkeypatch, order, breaks):
    """Whatever the batches' order, and wherever the second one breaks off."""
    path = str(tmp_path / "lake")
    for at, provider in enumerate(order):
        batch = responses(spark, *[a for a in ANSWERS if a[1] == provider])
        if at == 1 and breaks:
            before = shown(lake.read_silver(spark, path))
            break_off(monkeypatch, breaks)
            with pytest.raises(Exception, match="gone"):
                jobs.ingest_batch(batch, path)
            monkeypatch.undo()
            assert shown(lake.read_silver(spark, path)) == before
        jobs.ingest_batch(batch, path)
    want = analytics.rebuild(archived(spark, path))[0]
    assert shown(lake.read_silver(spark, path)) == shown(want)
    assert {r.external_id: r.status for r in lake.read_silver(spark, path).documents.collect()} == {"late": "enriched", "better": "enriched", "gone": "failed", "other": "enriched"}
    lake.compact(spark, path, archived(spark, path).schema, 4)
    assert shown(lake.read_silver(spark, path)) == shown(want) and archived(spark, path).count() == len(ANSWERS)


def test_a_broken_batch_is_settled_by_another_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lake")
    break_off(monkeypatch, "transcripts")
    with pytest.raises(Exception, match="gone"):
        jobs.ingest_batch(raw(spark, 1, 2, 3), path)
    monkeypatch.undo()
    jobs.ingest_batch(raw(spark, 5), path)
    assert counts(spark, path) == [4, 4, 3, 3]


def test_a_retried_item_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "lake")
    jobs.ingest_batch(responses(spark, ("x", "supadata", {}, 500)), path)
    assert [r.status for r in lake.read_silver(spark, path).documents.collect()] == ["failed"]
    jobs.ingest_batch(responses(spark, ("x", "supadata", SAYS, 200)).withColumn("fetched_at", F.lit(7).cast("long")), path)
    assert [r.status for r in lake.read_silver(spark, path).documents.collect()] == ["enriched"]
    assert counts(spark, path) == [2, 1, 1, 1]


def files_read(df):
    """Files that the plan's scans read, by their metrics."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            todo.append(plan.executedPlan())
        if plan.metrics().contains("numFiles"):
            found += plan.metrics().apply("numFiles").value()
        todo += [plan.children().apply(i) for i in range(plan.children().size())] + ([plan.plan()] if plan.nodeName().endswith("QueryStage") else [])
    return found


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    """The plan prunes to the batch's buckets; what comes to other buckets adds nothing to what a batch reads."""
    path, own, read = str(tmp_path / "lake"), raw(spark, 1), []
    jobs.ingest_batch(own, path)
    schema = archived(spark, path).schema
    for extra in (range(100, 120), range(200, 300)):
        now = lake.open_lake(spark, path)
        bucket = lake.buckets_of(own, now)
        others = [int(r.external_id) for r in raw(spark, *extra).filter(lake.bucket_of(F.col("external_id"), now.buckets) != bucket[0]).collect()]
        jobs.ingest_batch(raw(spark, *others), path)
        now = lake.open_lake(spark, path)
        looked_up, held = lake.archive(spark, now, schema, bucket), lake.held_documents(spark, now, bucket)
        for rows in (looked_up, held):
            plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
            assert "bucket#" in plan.split("PartitionFilters")[1].split("\n")[0]
        read.append((files_read(looked_up), files_read(held)))
    assert read == [(1, 1), (1, 1)]
    assert files_read(lake.archive(spark, now, schema)) > 20


def test_the_latest_record_of_an_item_counts(spark, tmp_path):
    path = str(tmp_path / "lake")
    old, new = raw(spark, 1), raw(spark, 1).withColumns({"fetched_at": F.lit(5).cast("long"), "payload": F.lit(json.dumps({"content": "later"}))})
    jobs.ingest_batch(old.union(new).repartition(3), path)
    assert [r.text for r in lake.read_silver(spark, path).segments.collect()] == ["later"]
    assert counts(spark, path) == [2, 1, 1, 1]


def test_failover_between_providers(spark, tmp_path):
    """A blocked provider falls through, an unavailable one ends the search, a rejected record counts as an error."""
    path, rows = str(tmp_path / "lake"), []

    def add(item, provider, payload, status):
        rows.append((provider, "transcript", "t", "s", item, "en", 1, json.dumps(payload), status))

    snippets = {"snippets": [{"text": "s", "start": 2.0004}]}
    add("blocked", "supadata", {}, 429), add("blocked", "ytapi", snippets, 200)
    add("none", "supadata", {}, 404), add("none", "ytapi", snippets, 200)
    add("broken", "supadata", {"content": [{"offset": 1}]}, 200), add("broken", "ytapi", snippets, 200)
    add("all", "supadata", {}, 500), add("all", "ytapi", {"snippets": [{"text": "no start"}]}, 200)
    jobs.ingest_batch(spark.createDataFrame(rows, RAW + ", http_status int"), path)
    silver = lake.read_silver(spark, path)
    documents = {r.external_id: r.status for r in silver.documents.collect()}
    assert documents == {"blocked": "enriched", "none": "failed", "broken": "enriched", "all": "failed"}
    assert sorted(r.provider for r in silver.transcripts.collect()) == ["ytapi", "ytapi"]
    assert {r.offset_ms for r in silver.segments.collect()} == {2000}


def test_payloads_lie_in_the_lake_only(spark, tmp_path, monkeypatch):
    """What an ingest writes beside the lake holds keys and marks but no payload, and payloads are picked by marks without a shuffle; a batch that is partly known adds the rest."""
    path, place = str(tmp_path / "lake"), ("bucket", *lake.PLACE)
    monkeypatch.setattr(jobs, "fresh_folder", lambda _, name: str(tmp_path / f"beside/{name}-{os.urandom(4).hex()}"))

    def long(*items):
        return responses(spark, *[(i, "supadata", {"content": [{"text": os.urandom(50_000).hex(), "offset": 0}]}, 200) for i in items])

    jobs.ingest_batch(long("a", "b"), path)
    old = archived(spark, path).select("provider", "endpoint", "tenant_id", "source_id", "external_id", "lang", "fetched_at", "payload", "http_status").localCheckpoint()
    jobs.ingest_batch(old.union(long("c")), path)
    assert counts(spark, path) == [3, 3, 3, 3]
    assert sum(f.stat().st_size for f in (tmp_path / "beside").rglob("*.parquet")) < 200_000 and not list((tmp_path / "lake" / "aside").iterdir())
    rows = lake.archive(spark, lake.open_lake(spark, path), archived(spark, path).schema)
    some = lake.located(rows).filter("external_id <> 'b'").select(*place)
    picked = lake.marked(rows, lake.mark(some, "bucket", str(tmp_path / "marks")))
    assert sorted(r.external_id for r in picked.collect()) == ["a", "c"] and "SortMergeJoin" not in picked._jdf.queryExecution().executedPlan().toString()


def moved(spark, after=-1):
    """The last stage that has run, and the bytes shuffled or spilled and the bytes written by stages after ``after``."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    stages = [s for s in map(found.apply, range(found.size())) if s.stageId() > after]
    return max((s.stageId() for s in stages), default=after), sum(s.shuffleWriteBytes() + s.diskBytesSpilled() for s in stages), sum(s.outputBytes() for s in stages)


def test_an_ingest_moves_a_payload_once(spark, tmp_path):
    """Two batches by item, the second replayed: a batch's payloads are shuffled once and written once, new segments are written once, and little else is moved."""
    path, size = str(tmp_path / "lake"), 1_000_000
    batches = [responses(spark, *[(i, "supadata", {"content": [{"text": os.urandom(size // 2).hex(), "offset": 0}]}, 200) for i in items]).localCheckpoint() for items in ("ab", "cd")]
    before, *_ = moved(spark)
    for batch in (*batches, batches[1]):
        jobs.ingest_batch(batch, path)
    _, shuffled, written = moved(spark, before)
    assert counts(spark, path) == [4, 4, 4, 4]
    assert 5 * size < shuffled < 7 * size and 8 * size < written < 11 * size  # six records came, whose segments are four; compression takes a little


@pytest.mark.parametrize("most, shuffled", [(lake.BROADCAST_MARKS, 1), (0, 2)])
def test_a_partly_known_batch_is_shuffled_once(spark, tmp_path, monkeypatch, most, shuffled):
    """Its new part is copied without dealing rows to buckets again, unless there are very many marks."""
    path, write, written = str(tmp_path / "lake"), lake.write_run, []
    jobs.ingest_batch(raw(spark, 1, 2), path)
    monkeypatch.setattr(lake, "BROADCAST_MARKS", most)
    monkeypatch.setattr(lake, "write_run", lambda rows, now, table, run: written.append(table) or write(rows, now, table, run))
    jobs.ingest_batch(raw(spark, 2, 3, 4, 4, 5), path)
    assert written.count("bronze") == shuffled and counts(spark, path) == [5, 5, 3, 3]
    assert len(list((tmp_path / "lake" / "bronze").glob("run=2/*/*.parquet"))) == archived(spark, path).filter("external_id in ('3', '4', '5')").select(lake.bucket_of(F.col("external_id"), 64)).distinct().count()


def test_settling_parses_a_payload_once_and_reads_the_marks_runs(spark, tmp_path):
    """No condition on segments is moved below their parsing; payloads of runs without a marked row are not read. Transcripts without segments have none."""
    path = str(tmp_path / "lake")
    rows = responses(spark, ("a", "supadata", SAYS, 200), ("b", "supadata", {"content": []}, 200), ("c", "ytapi", SNIPPETS, 200), ("d", "supadata", {"content": "plain"}, 200))
    segments = ingest.fan_out(ingest.judged_answers(ingest.with_columns(rows, ingest.OPTIONAL), ("supadata", "ytapi"))).segments
    assert segments._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 2  # one a reader
    assert sorted((r.idx, r.text) for r in segments.collect()) == [(0, "one"), (0, "plain"), (0, "two")]
    for item in ("a", "b"):
        jobs.ingest_batch(rows.filter(F.col("external_id") == item), path)
    archive = lake.archive(spark, lake.open_lake(spark, path), archived(spark, path).schema)
    places = lake.located(archive).filter("external_id = 'b'").select("run", "bucket", *lake.PLACE)
    picked = lake.marked(archive, lake.mark(places, "bucket", str(tmp_path / "marks")))
    assert [r.external_id for r in picked.collect()] == ["b"] and files_read(archive) == 2 and files_read(picked.select("payload")) == 2  # a file of the archive, one of the marks


def test_ingest_stream_equals_batches(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "lake")
    for part in ((1, 2), (2, 3), (4,)):
        raw(spark, *part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.ingest_stream(stream, path, str(tmp_path / "c")).awaitTermination(120)
    assert counts(spark, path) == [4, 4, 2, 2]


@pytest.mark.parametrize("twice", [False, True])
def test_intake_stream(spark, tmp_path, twice):
    drop, path = tmp_path / "drop", str(tmp_path / "seeds")
    drop.mkdir()
    (drop / "a.json").write_text(json.dumps(["@one", "https://youtube.com/@two", "junk"]))
    jobs.intake_stream(spark, str(drop), path, str(tmp_path / "c")).awaitTermination(60)
    if twice:
        (drop / "b.json").write_text(json.dumps(["@ONE", "@three"]))
        jobs.intake_stream(spark, str(drop), path, str(tmp_path / "c")).awaitTermination(60)
    assert sorted(r.handle for r in spark.read.parquet(path).collect()) == ["@one", "@three", "@two"] if twice else ["@one", "@two"]


def test_rewritten_files_give_their_new_rows(spark, tmp_path):
    """Over restarts, as read_intake does with its ledger; what does not change is not read again."""
    drop, path = tmp_path / "drop", str(tmp_path / "seeds")
    drop.mkdir()

    def put(name, refs, at):
        (drop / name).write_text(json.dumps(refs))
        os.utime(drop / name, (at, at))

    def run():
        assert jobs.intake_stream(spark, drop.as_uri(), path, str(tmp_path / "c"), rewritten=True).awaitTermination(60)
        return sorted(r.handle for r in spark.read.parquet(path).collect())

    put("a.json", ["@one", "@two"], 1_700_000_000)
    put("b.json", ["@three"], 1_700_000_000)
    ledger = spark.createDataFrame([], "path string, mtime timestamp")
    seen = intake.read_intake(spark, str(drop), ledger)[0].cache()
    assert seen.count() == 3  # the ledger is taken now
    assert run() == ["@one", "@three", "@two"]
    put("a.json", ["@one", "@TWO", "@four"], 1_700_000_500)  # a later time
    put("b.json", ["@five"], 1_600_000_000)  # an earlier one
    again = intake.read_intake(spark, str(drop), seen.select("path", "mtime").distinct())[0]
    assert sorted(r.ref for r in again.collect()) == ["@TWO", "@five", "@four", "@one"]
    assert run() == ["@five", "@four", "@one", "@three", "@two"] == run()
    reader = dropped.DroppedReader(drop.as_uri())
    end = reader.latestOffset()
    assert reader.partitions(end, end) == [] and [f for p in reader.partitions(reader.initialOffset(), end) for f in p.files] == [("a.json", 1_700_000_500_000_000), ("b.json", 1_600_000_000_000_000)]
    put("a.json", ["@six"], 1_700_000_900)
    assert [r[0].rsplit("/", 1)[1] for p in reader.partitions(reader.initialOffset(), end) for r in reader.read(p)] == ["b.json"]


def test_held_rows_take_a_call_a_block():
    """Early rows go to the state store and come back in blocks, whatever their number; results are those of the right order."""
    import pandas as pd

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Blocks(dict):
        calls = 0

        def containsKey(self, key):
            Blocks.calls += 1
            return key in self

        def getValue(self, key):
            Blocks.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            Blocks.calls += 1
            self[key] = value

        def removeKey(self, key):
            Blocks.calls += 1
            del self[key]

    class Handle:
        def getValueState(self, *_):
            return Value()

        def getMapState(self, *_):
            return Blocks()

        def registerTimer(self, _):
            pass

    processor, n, got = jobs._OrderedAdmission(100, 0, 1000), 3 * jobs.HELD, []
    processor.init(Handle())
    for third in (2, 1, 0):
        own = [p for p in range(n) if p % 3 == third]
        frames = [pd.DataFrame({"position": part, "cost": [p % 5 + 1 for p in part], "at": pd.Timestamp(0)}) for part in (own[600:], own[:600])]
        for frame in processor.handleInputRows((1,), iter(frames), None):
            got += list(zip(frame["position"], frame["admitted"], strict=True))
    spent, want = 0, []
    for p in range(n):
        fits = spent + p % 5 + 1 <= 100
        spent += (p % 5 + 1) * fits
        want.append((p, fits))
    assert got == want and not processor.blocks and Blocks.calls < 60
