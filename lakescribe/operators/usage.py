"""Usage: summaries, spend, and admission under a budget (AG1, SNK4, WN5, D9)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import day_start, month_start
from ..functions.storage import fresh_folder


def append_usage(events: DataFrame, path: str) -> None:
    """SNK4: append usage events, partitioned by day."""
    events.withColumn("day", F.to_date("occurred_at")).write.mode("append").partitionBy("day").parquet(path)


def usage_summary(events: DataFrame, now: Column, keys: DataFrame | None = None, by: Sequence[str] = ("tenant_id", "provider")) -> DataFrame:
    """AG1: credits since the day's start, the month's start and 30 days ago (no upper bound), their daily average, and has_data.

    One pass; ``keys`` (columns ``by``) also get a row of zeros where they have no event.
    """
    since = {"today": day_start(now), "month": month_start(now), "last_30d": now - F.expr("INTERVAL 30 DAYS")}
    sums = [F.coalesce(F.sum(F.when(F.col("occurred_at") >= start, F.col("credits"))), F.lit(0)).alias(name) for name, start in since.items()]
    found = events.groupBy(*by).agg(*sums, F.lit(True).alias("has_data"))
    if keys is not None:
        found = keys.select(*by).distinct().join(found, list(by), "left").fillna(0, list(since)).fillna(False, ["has_data"])
    return found.withColumn("avg_per_day", F.col("last_30d") / 30.0)


def spend_by(events: DataFrame, grain: str = "day", keys: Sequence[str] = ("endpoint", "external_id")) -> DataFrame:
    """Credits per period and key, and their rank within the period."""
    summed = events.groupBy(F.date_trunc(grain, "occurred_at").alias("period"), *keys).agg(F.sum("credits").alias("credits"))
    return summed.withColumn("rank", F.rank().over(Window.partitionBy("period").orderBy(F.desc("credits"))))


def admit_unit(requests: DataFrame, budget: int, by: str = "tenant_id", order: Sequence[str] = ("position",)) -> DataFrame:
    """WN5 where every request costs 1: the first ``budget`` of each tenant are admitted."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return requests.withColumn("admitted", place <= budget)


def admit(requests: DataFrame, budget: int, by: str = "tenant_id", order: Sequence[str] = ("position",), cost: str = "cost") -> DataFrame:
    """WN5: in order, a request is admitted while spent + cost stays within ``budget``; a refused one spends nothing.

    A request that finds more than the remaining budget does not stop later, cheaper ones, so a
    running sum is not enough. But a stretch of requests maps what was spent before it (0 to ``budget``) to
    what is spent after it, and such maps compose. So requests are dealt by ranges of (tenant, order), and a tenant's
    rows may lie in many tasks:

    1. Each task folds its rows. A tenant that begins within it is decided at once; the first tenant of a range may go on from
       earlier ranges, so its rows stay open and the task gives their map instead.
    2. A tenant's maps are applied in order, from 0: one number per range.
    3. The open rows are folded again, with the number their range starts from.

    Tasks stream their rows, and hold one map of ``budget`` + 1 numbers at most. Costs are whole numbers, not negative and not NULL.
    """
    spark, folder = requests.sparkSession, fresh_folder(requests.sparkSession, "admission")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    # written first, as the bounds of the ranges need a pass of their own
    requests.write.parquet(f"{folder}/requests")
    dealt = spark.read.schema(requests.schema).parquet(f"{folder}/requests").repartitionByRange(by, *order).sortWithinPartitions(by, *order)
    dealt.mapInArrow(_folded(budget, by, cost), f"{fields}, admitted boolean, _part int, _map array<long>, _spent long").write.parquet(f"{folder}/folded")
    folded = spark.read.parquet(f"{folder}/folded")
    maps = folded.filter("_part is not null and (_map is not null or _spent is not null)").select(by, "_part", "_map", "_spent")
    starts = maps.repartition(by).sortWithinPartitions(by, "_part").mapInArrow(_started(by), "_part int, _start long")
    starts.write.parquet(f"{folder}/starts")
    rows = folded.filter("_map is null and _spent is null")
    # one number per range; ranges are as many as shuffle partitions
    open_rows = rows.filter("admitted is null").join(F.broadcast(spark.read.schema("_part int, _start long").parquet(f"{folder}/starts")), "_part")
    decided = open_rows.repartition("_part").sortWithinPartitions("_part", *order).mapInArrow(_decided(budget, cost), f"{fields}, admitted boolean")
    return rows.filter("admitted is not null").select(*requests.columns, "admitted").unionByName(decided.select(*requests.columns, "admitted"))


class _Stretch:
    """The map of a stretch of requests: from what was spent before to what is spent after.

    Starts that have come to the same number go on together. Once a stretch has used up the budget, few numbers are left,
    so most requests touch a short array.
    """

    def __init__(self, budget: int):
        self.budget, self.spent, self.of = budget, np.arange(budget + 1, dtype=np.int64), np.arange(budget + 1)
        self.added = 0

    def add(self, cost: int) -> None:
        self.spent += np.where(self.spent + cost <= self.budget, cost, 0)
        self.added += 1
        if self.added % 32 == 0:
            self.spent, own = np.unique(self.spent, return_inverse=True)
            self.of = own[self.of]

    def map(self) -> np.ndarray:
        return self.spent[self.of]


def _runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """First and end of the runs of equal values."""
    codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    return zip(cuts[:-1], cuts[1:], strict=True)


def _fold(costs: list[int], spent: int, budget: int) -> tuple[list[bool], int]:
    admitted = []
    for c in costs:
        fits = spent + c <= budget
        admitted.append(fits)
        if fits:
            spent += c
    return admitted, spent


def _folded(budget: int, by: str, cost: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, tenant, spent, stretch, seen = TaskContext.get().partitionId(), True, None, 0, _Stretch(budget), False
        shape = None

        def summary(values, name) -> pa.RecordBatch:
            """A row that stands for a stretch: the first tenant's map, or what the last tenant, who begins here, has spent."""
            nulls = {f.name: pa.nulls(1, f.type) for f in shape}
            nulls[by] = pa.array([tenant], shape.field(by).type)
            own = {"_map": pa.array([values if name == "_map" else None], pa.list_(pa.int64())), "_spent": pa.array([values if name == "_spent" else None], pa.int64())}
            return pa.RecordBatch.from_arrays([*nulls.values(), pa.array([None], pa.bool_()), pa.array([part], pa.int32()), own["_map"], own["_spent"]], names=[*nulls, "admitted", "_part", "_map", "_spent"])

        for batch in batches:
            if not batch.num_rows:
                continue
            shape, costs, admitted = batch.schema, batch.column(cost).to_pylist(), []
            for a, b in _runs(batch.column(by)):
                value = batch.column(by)[a].as_py()
                if seen and value != tenant:
                    if first:
                        yield summary(stretch.map().tolist(), "_map")
                    first, spent = False, 0
                tenant, seen = value, True
                if first:
                    for c in costs[a:b]:
                        stretch.add(c)
                    admitted += [None] * (b - a)
                else:
                    own, spent = _fold(costs[a:b], spent, budget)
                    admitted += own
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(admitted, pa.bool_()), pa.array(np.full(n, part, np.int32)), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], names=[*batch.schema.names, "admitted", "_part", "_map", "_spent"])
        if seen:
            yield summary(stretch.map().tolist(), "_map") if first else summary(spent, "_spent")

    return run


def _started(by: str) -> Callable:
    """What a tenant has spent before each range that gives its map; rows come by tenant and range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant, spent = (), 0
        for batch in batches:
            parts, starts = [], []
            for at in range(batch.num_rows):
                own = (batch.column(by)[at].as_py(),)
                if own != tenant:
                    tenant, spent = own, 0
                known = batch.column("_spent")[at].as_py()
                if known is not None:
                    spent = known
                    continue
                parts.append(batch.column("_part")[at].as_py())
                starts.append(spent)
                spent = batch.column("_map")[at].values[spent].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(starts, pa.int64())], names=["_part", "_start"])

    return run


def _decided(budget: int, cost: str) -> Callable:
    """Admission of rows that come by range and order, from the number their range starts with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, spent = None, 0
        for batch in batches:
            costs, admitted = batch.column(cost).to_pylist(), []
            for a, b in _runs(batch.column("_part")):
                if batch.column("_part")[a].as_py() != part:
                    part, spent = batch.column("_part")[a].as_py(), batch.column("_start")[a].as_py()
                own, spent = _fold(costs[a:b], spent, budget)
                admitted += own
            kept = [c for c in batch.schema.names if c not in ("_part", "_map", "_spent", "_start", "admitted")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(admitted, pa.bool_())], names=[*kept, "admitted"])

    return run
