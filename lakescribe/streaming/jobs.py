"""Structured Streaming forms of the push-style flows (ST1-ST4); each has a batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from ..functions.storage import exists, fresh_folder, move, remove
from ..operators.ingest import ITEM, OPTIONAL, fan_out, ingest_summary, judged_answers, known_items, settled_items, with_columns
from ..operators.normalize import METADATA, TRANSCRIPTS, assign_provenance
from ..operators.seeds import append_seeds, classify_ref, seed_defaults
from ..sources import lake
from ..sources.bronze import bronze_records, new_places
from ..sources.dropped import DroppedFiles
from ..sources.intake import parse_intake


def run_progress(events: DataFrame) -> DataFrame:
    """ST2, in batch or as a stream in update mode: per run its total, position, counters, last detail, status and credits.

    ``events``: run_id, seq, kind, current, total, detail, status, credits, and optionally n, how many items an event
    stands for (1). Values are taken by the highest seq, so late events change nothing they should not.
    """
    kind = F.col("kind")
    moving = kind.isin("fetching", "fetched", "skipped", "failed")

    def count(name: str) -> Column:
        return (F.coalesce(F.sum(F.when(kind == name, F.col("n"))), F.lit(0)) if "n" in events.columns else F.count_if(kind == name)).alias(name)

    return events.groupBy("run_id").agg(
        F.max_by("total", F.when(kind == "discovered", F.col("seq"))).alias("total"),
        F.max_by("current", F.when(moving, F.col("seq"))).alias("current"),
        *[count(name) for name in ("fetched", "skipped", "failed")],
        F.max_by("detail", F.when(kind != "skipped", F.col("seq"))).alias("detail"),
        F.max_by("status", F.when(kind == "run_complete", F.col("seq"))).alias("status"),
        F.max_by("credits", F.when(kind == "run_complete", F.col("seq"))).alias("credits"),
    )


class _Admission(StatefulProcessor):
    def __init__(self, budget: int):
        self.budget = budget

    def init(self, handle) -> None:
        self.spent = handle.getValueState("spent", "spent long")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        frame = pd.concat(list(rows)).sort_values("position")  # one tenant's rows of a micro-batch, which the source's trigger bounds
        spent = self.spent.get()[0] if self.spent.exists() else 0
        admitted = []
        for cost in frame["cost"]:
            admitted.append(bool(spent + cost <= self.budget))
            spent += int(cost) * admitted[-1]
        self.spent.update((spent,))
        yield frame[["tenant_id", "position", "cost"]].assign(admitted=admitted)

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, budget: int) -> DataFrame:
    """ST3: requests (tenant_id, position, cost) admitted while the tenant's budget lasts; the state is one number per tenant.

    Batches must come in order of position, and a tenant's rows of one batch are ordered in memory:
    bound the batch at the source (``maxBytesPerTrigger``, ``maxFilesPerTrigger``). Needs the RocksDB
    state store. ``operators.usage.admit`` is the batch form, which holds no rows.
    """
    return requests.groupBy("tenant_id").transformWithStateInPandas(_Admission(budget), "tenant_id long, position long, cost long, admitted boolean", "Append", "None")


#: Positions whose held costs are one value of the state.
HELD = 1024


class _OrderedAdmission(StatefulProcessor):
    """Early rows are held in blocks of HELD positions, so that a call to the state store is for a block and not for a row."""

    def __init__(self, budget: int, first: int, patience_ms: int):
        self.budget, self.first, self.patience_ms = budget, first, patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "spent long, next long, held long")
        self.blocks = handle.getMapState("held", "block long", "positions array<long>, costs array<long>")

    def _judge(self, cost: int) -> bool:
        fits = self.spent + cost <= self.budget
        self.spent += cost if fits else 0
        return bool(fits)

    def _load(self, block: int) -> dict[int, int]:
        """The held rows of a block. Blocks that are open are in memory, one while rows are drained and those of an Arrow batch while it is taken."""
        if block not in self.open:
            stored = self.blocks.getValue((block,)) if self.stored else None
            self.open[block] = dict(zip(*stored, strict=True)) if stored else {}
            self.before[block] = len(self.open[block])
        return self.open[block]

    def _save(self) -> None:
        """Write the open blocks that have changed."""
        for block in list(self.open):
            rows, before = self.open.pop(block), self.before.pop(block)
            if rows and (block in self.changed):
                self.blocks.updateValue((block,), (list(rows), list(rows.values())))
                self.stored = True
            elif before and not rows:
                self.blocks.removeKey((block,))
            self.changed.discard(block)

    def _drain(self, out: list) -> None:
        """Take the held rows that are next in turn."""
        while self.count and self.next in (rows := self._load(self.next // HELD)):
            cost = rows.pop(self.next)
            self.count -= 1
            self.changed.add(self.next // HELD)
            out.append((self.next, cost, self._judge(cost)))
            self.next += 1
            if self.next % HELD == 0:
                self._save()

    def _restore(self) -> None:
        self.spent, self.next, self.count = self.progress.get() or (0, self.first, 0)
        self.stored, self.open, self.before, self.changed = self.count > 0, {}, {}, set()

    def _result(self, key, out: list) -> list:
        """Store what is known; a frame of the rows that are judged, none where there are none."""
        import pandas as pd

        self._save()
        self.progress.update((self.spent, self.next, self.count))
        return [pd.DataFrame({"tenant_id": [key[0]] * len(out), "position": [p for p, *_ in out], "cost": [c for _, c, _ in out], "admitted": [a for *_, a in out]})] if out else []

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        self._restore()
        for frame in rows:
            out: list = []
            for position, cost in sorted(zip(frame["position"].tolist(), frame["cost"].tolist(), strict=True)):
                if position > self.next:
                    held = self._load(position // HELD)
                    self.count += position not in held
                    held[position] = cost
                    self.changed.add(position // HELD)
                    continue
                out.append((position, cost, self._judge(cost)))  # in turn, or given up and late
                self.next = max(self.next, position + 1)
                self._drain(out)
            yield from self._result(key, out)
            if self.count:
                self.handle.registerTimer(int(frame["at"].max().value // 10**6) + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        """The gap's rows do not come: go on behind it."""
        self._restore()
        out: list = []
        if self.count:
            block = min(k[0] for k in self.blocks.keys())  # noqa: SIM118
            self.next = min(self._load(block))
            self._drain(out)
        result = self._result(key, out)
        if self.count:
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.patience_ms)
        yield from result

    def close(self) -> None:
        pass


def admit_stream_ordered(requests: DataFrame, budget: int, first: int = 0, patience_ms: int = 600_000) -> DataFrame:
    """ST3 for requests (tenant_id, position, cost, at) that come in any order; a tenant's positions count up from ``first``.

    ``at`` is an event time with a watermark, which bounds how late a row may come. A row that comes early is held, keyed by
    position in the state store, until its predecessors have come. If they don't by the time that the watermark is
    ``patience_ms`` past the rows that wait, a timer gives up the gap and goes on behind it; a row that still comes then is judged by
    what is spent. Rows are taken batch by batch of Arrow, so a task holds one batch, and the state one row for each that is
    early, in blocks of HELD positions: memory is bounded by the batch and a block, not by the micro-batch or the gap. Needs the RocksDB state store.
    """
    shape = "tenant_id long, position long, cost long, admitted boolean"
    return requests.groupBy("tenant_id").transformWithStateInPandas(_OrderedAdmission(budget, first, patience_ms), shape, "Append", "EventTime")


def _present(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``; empty where nothing has been written yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def progress_rows(outcomes: DataFrame, credits: DataFrame, run: str) -> DataFrame:
    """Event rows of an ingest for ``run_progress``: per source a run of its own, with one row for each kind that counts its items.

    ``outcomes``: (source_id, outcome) as AG2 has them, ``credits``: (source_id, credits). A run is complete, or partial if items failed.
    """
    summed = ingest_summary(outcomes).join(credits.hint("merge"), "source_id", "left")
    done = F.col("fetched") + F.col("already")

    def event(seq: int, kind: str, n: Column | None = None, **values: Column) -> Column:
        none = {"current": "long", "total": "long", "detail": "string", "status": "string", "credits": "long"}
        own = [values.get(name, F.lit(None)).cast(t).alias(name) for name, t in none.items()]
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), (F.lit(1) if n is None else n).cast("long").alias("n"), *own)

    status = F.when(F.col("failed") > 0, F.lit("partial")).otherwise(F.lit("complete"))
    events = F.array(
        event(0, "discovered", total=F.col("discovered")),
        event(1, "fetched", F.col("fetched"), current=F.col("fetched")),
        event(2, "skipped", F.col("already"), current=done),
        event(3, "failed", F.col("failed"), current=done + F.col("failed"), detail=F.concat(F.col("failed"), F.lit(" failed"))),
        event(4, "run_complete", status=status, detail=status, credits=F.coalesce("credits", F.lit(0))),
    )
    return summed.select(F.concat_ws(":", F.lit(run), "source_id").alias("run_id"), F.explode(events).alias("e")).select("run_id", "e.*")


def ingest_batch(raw: DataFrame, path: str, order: Sequence[str] = tuple(TRANSCRIPTS), sink: str | None = None, run: str | None = None) -> lake.Lake:
    """ST4 for one batch of recorded responses (provider, endpoint, tenant_id, source_id, external_id, lang, fetched_at, payload).

    Archives what is new, then settles every item that has unsettled records over all that the archive
    knows of it, whichever batch that came in. So an answer that comes late replaces the item's rows, a retried
    fetch does the same, and the tables equal ``rebuild`` of the archive whatever the batches were. The records of all
    providers are read, in the failover's ``order``; metadata fills the documents. Replaying a batch changes nothing.

    Archive and tables are each made visible by one pointer row (sources.lake). A run that breaks off
    between them is made good by the next batch, even an empty one.

    Payloads are shuffled once, on their way into the archive's buckets, where the batch is written as the next run before it
    counts. What is new in it, latest of an item and chosen by the failover is found over keys; marks, a bit a row of the files
    (``lake.mark``), then pick the rows. Only a batch that is partly known is written again, without its known part and without a shuffle.

    ``sink``: a table of progress rows; those of the batch, as ``run``, are appended last. They count what the run has written, not
    what tasks have seen, so tasks that ran twice do not tell; a run that breaks off before them leaves none.
    """
    spark, now = raw.sparkSession, lake.open_lake(raw.sparkSession, path)
    batch, at = fresh_folder(spark, "ingest-batch"), f"{path}/{lake.BRONZE}/run={now.bronze + 1}"
    arrived = bronze_records(with_columns(raw, OPTIONAL))
    schema = arrived.schema
    lake.write_run(arrived, now, lake.BRONZE, now.bronze + 1)
    records, aside = lake.run_rows(spark, at, schema), None
    own = lake.buckets_of(records, now)
    place = ("bucket", *lake.PLACE)
    new = lake.mark(new_places(lake.located(records), lake.archive(spark, now, schema, own), place), "bucket", f"{batch}/new")
    if 0 < new.rows < records.count():
        aside = f"{path}/aside/{uuid.uuid4().hex}"
        move(spark, at, aside)
        records = lake.run_rows(spark, aside, schema)
        lake.copy_run(records, new, now, now.bronze + 1)
    if new.rows:
        now = lake.commit(spark, now._replace(bronze=now.bronze + 1))
    settled = now.covered < now.bronze
    if settled:
        now = settle(spark, now, schema, order)
    if sink:
        documents = spark.read.schema(lake.SHAPES["documents"]).parquet(f"{path}/documents/run={now.silver}") if settled else spark.createDataFrame([], lake.SHAPES["documents"])
        known = records.select(*ITEM).distinct().join(documents.select(*ITEM).hint("merge"), ITEM, "left_anti").select("source_id", F.lit("already").alias("outcome"))
        outcomes = documents.select("source_id", F.when(F.col("status") == "enriched", "fetched").otherwise("failed").alias("outcome")).unionByName(known)
        added = lake.run_rows(spark, at, schema) if new.rows else spark.createDataFrame([], schema)
        paid = added.groupBy("source_id").agg(F.count(F.lit(1)).alias("credits"))
        progress_rows(outcomes, paid, run or uuid.uuid4().hex).write.mode("append").parquet(sink)
    if aside:
        remove(spark, aside)
    return now


def settle(spark: SparkSession, now: lake.Lake, schema: StructType, order: Sequence[str] = tuple(TRANSCRIPTS)) -> lake.Lake:
    """Settle the items of the archive's runs that the silver tables don't cover yet, over all their records."""
    batch = fresh_folder(spark, "settled")
    own = sorted(r[0] for r in lake.archive(spark, now, schema, after=now.covered).select("bucket").distinct().collect())
    archive, place = lake.archive(spark, now, schema, own), ("run", "bucket", *lake.PLACE)
    asked = (F.col("endpoint") == "transcript") & F.col("provider").isin(*order) | (F.col("endpoint") == "metadata") & F.col("provider").isin(*METADATA)
    slim = lake.located(archive).dropna(subset=ITEM).select(*ITEM, "provider", "endpoint", "fetched_at", F.unhex("key").alias("key"), *place)
    answers = slim.repartition(*ITEM).groupBy(*ITEM, "provider", "endpoint").agg(F.max_by(F.struct(*place), F.struct("fetched_at", "key")).alias("_l"), F.max("run").alias("_run"))
    touched = answers.groupBy(*ITEM).agg(F.collect_list(F.when(asked, F.col("_l"))).alias("_l"), F.max("_run").alias("_run")).filter(F.col("_run") > now.covered)
    latest = touched.select(F.explode("_l").alias("_l")).select("_l.*")
    known = lake.marked(archive, lake.mark(latest, "bucket", f"{batch}/latest"))
    # the failover, over what every answer came to
    judged_answers(known, order).select(*ITEM, "provider", "outcome", "lang", *OPTIONAL, "provider_unit", *place).write.parquet(f"{batch}/judged")
    judged = spark.read.parquet(f"{batch}/judged")
    found = assign_provenance(judged.filter("outcome = 'ok'")).drop("outcome", "provider_unit", "http_status", "is_generated")
    items = settled_items(known, judged, order).join(found.hint("merge"), [*ITEM, "provider"], "left").withColumn("spoken", F.col("_row").isNotNull())
    items.write.parquet(f"{batch}/items")
    items = spark.read.parquet(f"{batch}/items")
    spoken = lake.mark(items.filter("spoken").select(*place), "bucket", f"{batch}/spoken")
    silver = fan_out(items)
    segments = fan_out(judged_answers(lake.marked(archive, spoken), order)).segments
    held = lake.held_documents(spark, now, own)
    replaced = known_items(silver.documents, held.hint("merge")).select("document_id")
    for table, rows in (("segments", segments), ("transcripts", silver.transcripts), ("replaced", replaced), ("documents", silver.documents)):
        lake.write_run(rows, now, table, now.silver + 1)
    return lake.commit(spark, now._replace(silver=now.silver + 1, covered=now.bronze))


def ingest_stream(raw: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """ST4: ``ingest_batch`` for every micro-batch that is there."""
    return raw.writeStream.foreachBatch(lambda batch, _: ingest_batch(batch, path) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def intake_rows(files: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ST1 for one batch of files: (added seeds, errors) through SRC3, PRJ9, JN4 and PRJ10."""
    candidates, errors = parse_intake(files)
    judged = classify_ref(candidates, "ref")
    unread = judged.filter("error is not null").select("path", "mtime", "pos", "error")
    handles = judged.filter("kind = 'handle'").select(F.col("ref").alias("handle"), F.struct("path", "pos").alias("position"), F.lit(None).cast("int").alias("subscribers"))
    added, _ = append_seeds(handles, seeds)
    return seed_defaults(added), errors.unionByName(unread)


def intake_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, rewritten: bool = False) -> StreamingQuery:
    """ST1: new files of ``folder`` become seed rows in ``path``.

    Spark's file source does not read a rewritten file again. With ``rewritten`` a source does that knows files by name and time
    (sources.dropped); ``folder`` is then a URI. Rows that a file had before are there already, so it gives its new rows only.
    """
    if rewritten:
        spark.dataSource.register(DroppedFiles)
        files = spark.readStream.format("dropped_files").option("folder", folder).load()
    else:
        files = spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), "value")

    def take(batch: DataFrame, _: int) -> None:
        added, _errors = intake_rows(batch, _present(spark, path, "handle string"))
        added.drop("position").write.mode("append").parquet(path)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
