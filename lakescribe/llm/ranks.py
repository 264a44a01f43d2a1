"""Places of rows within their group in a given order, without a task per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .scratch import stored


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and each row's place in its run of equal groups (first column); a run may go on over batches."""
    part, held, before = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        group = batch.column(0)
        codes = group.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])
        places = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        first = (group[0].as_py(),)
        if first == held:
            places[: starts[1] if len(starts) > 1 else n] += before
        held, before = (group[n - 1].as_py(),), int(places[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(places)], names=[*batch.schema.names, "_part", "_at"])


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with a column rank: the place, from 0, within ``group`` (any value, NULL too) by the columns ``order``.

    The rows are dealt by ranges of (group, order), so that a group of any size spreads over many tasks,
    sorted, numbered task by task and written. Only a range's first group can have rows in earlier
    ranges, so one number a range, which the driver adds up, turns places in the range into places in
    the group. Rows that agree in group and order get distinct ranks in no set order. ``rows`` is read
    twice (for the ranges' bounds, too): hand in a written table.
    """
    spark = rows.sparkSession
    sort = [group, *order]
    dealt = rows.select(*sort, *[c for c in rows.columns if c not in sort]).repartitionByRange(*sort).sortWithinPartitions(*sort)
    extra = [StructField("_part", LongType()), StructField("_at", LongType())]
    numbered = stored(dealt.mapInArrow(_counted, StructType([*dealt.schema.fields, *extra])), "numbered")
    known = F.col(group).isNotNull()
    ends = numbered.groupBy("_part").agg(F.min(F.struct(known.alias("known"), F.col(group).alias("value"))).alias("first"), F.max(F.struct(known.alias("known"), F.col(group).alias("value"), "_at")).alias("last"))
    offsets, held, before = [], None, 0
    for row in sorted(ends.collect(), key=lambda r: r["_part"]):  # one row a shuffle partition
        first, last = tuple(row["first"]), tuple(row["last"])
        offset = before if first == held else 0
        offsets.append((row["_part"], offset, first[1]))
        held, before = last[:2], last[2] + 1 + (offset if last[:2] == first else 0)
    shape = StructType([StructField("_part", LongType()), StructField("_offset", LongType()), StructField("_first", rows.schema[group].dataType)])
    joined = numbered.join(F.broadcast(spark.createDataFrame(offsets, shape)), "_part")
    rank = F.col("_at") + F.when(F.col(group).eqNullSafe(F.col("_first")), F.col("_offset")).otherwise(0)
    return joined.withColumn("rank", rank).drop("_part", "_at", "_offset", "_first")
