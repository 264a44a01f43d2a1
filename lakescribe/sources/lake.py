"""A lake of archived responses and silver tables that change together (SNK1, SNK3, ST4).

Under one path lie the folders ``bronze``, ``documents``, ``transcripts``, ``segments`` and ``replaced``, each
partitioned by the run that wrote it, and bronze and documents below that by a bucket of the external id. The folder
``pointer`` has a row for every step that is done; the last one tells which runs count. A run writes its
folders first and its pointer row last, so readers see all of it or nothing, and one that breaks off is
written again under the same number. Tables only grow: a document that is settled again has its new rows in the new run
and a row in ``replaced``, by which readers leave out the old ones. ``compact`` folds all of it into one run.

A lookup for a batch reads the buckets that the batch's ids fall into. A bucket's size is bounded by
compacting into more buckets as the lake grows, so that a batch costs its own size.

One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.storage import exists
from ..operators.ingest import DOCUMENT, TRANSCRIPT, Silver

BUCKETS = 64
#: Replaced documents that are broadcast at most, when tables are read.
BROADCAST_REPLACED = 1_000_000
#: Marks, of 64 rows each, that are broadcast at most.
BROADCAST_MARKS = 1_000_000
#: Where a row of a table in folders lies: the file's name (which a task may use in several folders) and the row in it.
PLACE = ("_name", "_row")
BRONZE, TABLES = "bronze", ("documents", "transcripts", "segments")


def _listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


SHAPES = {
    "documents": f"document_id string, tenant_id string, source_id string, external_id string, {_listed(DOCUMENT)}, status string",
    "transcripts": f"transcript_id string, document_id string, tenant_id string, provider string, lang string, {_listed(TRANSCRIPT)}",
    "segments": "transcript_id string, document_id string, tenant_id string, idx int, text string, offset_ms long, duration_ms long",
}
_POINTER = "at long, bronze long, silver long, covered long, first_bronze long, first_silver long, buckets long"


class Lake(NamedTuple):
    """What counts of the lake at ``path``: bronze runs first_bronze to bronze, of which silver has settled those up to ``covered``."""

    path: str
    at: int
    bronze: int
    silver: int
    covered: int
    first_bronze: int
    first_silver: int
    buckets: int


def open_lake(spark: SparkSession, path: str, buckets: int = BUCKETS) -> Lake:
    """The lake as its last pointer row tells; a new one, with so many buckets, where there is none."""
    last = None
    if exists(spark, f"{path}/pointer"):
        last = spark.read.schema(_POINTER).parquet(f"{path}/pointer").agg(F.max(F.struct("*")).alias("p")).first()["p"]
    return Lake(path, *last) if last else Lake(path, 0, 0, 0, 0, 1, 1, buckets)


def commit(spark: SparkSession, lake: Lake) -> Lake:
    """Make ``lake`` what counts: one row, appended as a whole or not at all."""
    done = lake._replace(at=lake.at + 1)
    spark.createDataFrame([tuple(done[1:])], _POINTER).coalesce(1).write.mode("append").parquet(f"{lake.path}/pointer")
    return done


def bucket_of(external_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(external_id), F.lit(buckets)).cast("int")


def buckets_of(rows: DataFrame, lake: Lake) -> list[int]:
    """The buckets of the ids in ``rows`` (external_id), ``lake.buckets`` at most."""
    return sorted(r[0] for r in rows.select(bucket_of(F.col("external_id"), lake.buckets)).distinct().collect())


def write_run(rows: DataFrame, lake: Lake, table: str, run: int) -> None:
    """Write a table's rows of a run, in place of what a run that broke off has left."""
    writer = rows.drop("run", "bucket")
    if table in (BRONZE, "documents"):
        keyed = writer.withColumn("bucket", bucket_of(F.col("external_id"), lake.buckets))
        writer = keyed.hint("rebalance", F.col("bucket")).write.partitionBy("bucket")  # a large bucket is written by several tasks
    else:
        writer = writer.write
    writer.mode("overwrite").parquet(f"{lake.path}/{table}/run={run}")


def located(rows: DataFrame) -> DataFrame:
    """``rows`` of files with their PLACE."""
    return rows.select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_row"))


class Marks(NamedTuple):
    """Marked rows of files: a bit a row, 64 of them in a ``_mask``, by ``folder`` (the partition column below which files lie); the ``runs`` that they lie in, if known; ``few`` enough for a broadcast or not."""

    folder: str
    masks: DataFrame
    rows: int
    runs: list[int] | None
    few: bool


def mark(places: DataFrame, folder: str, path: str) -> Marks:
    """Marks, written to ``path``, of ``places`` (``folder``, PLACE, and optionally run)."""
    bit = F.expr("shiftleft(1L, cast(_row % 64 as int))")
    run = F.max("run") if "run" in places.columns else F.lit(None).cast("int")  # a file's name is in one run only
    places.groupBy(folder, "_name", F.expr("_row div 64").alias("_word")).agg(F.bit_or(bit).alias("_mask"), run.alias("_run")).write.parquet(path)
    found = places.sparkSession.read.parquet(path)
    count, rows, runs = found.agg(F.count(F.lit(1)), F.sum(F.bit_count("_mask")), F.sort_array(F.collect_set("_run"))).first()
    masks, few = found.drop("_run"), count <= BROADCAST_MARKS
    return Marks(folder, F.broadcast(masks) if few else masks.hint("merge"), rows or 0, runs if "run" in places.columns else None, few)


def marked(rows: DataFrame, marks: Marks) -> DataFrame:
    """Those of ``rows``, read from files, that are marked. Only the marks' runs are read; rows are not shuffled unless there are very many marks."""
    at = located(rows if marks.runs is None else rows.filter(F.col("run").isin(*marks.runs))).withColumn("_word", F.expr("_row div 64"))
    return at.join(marks.masks, [marks.folder, "_name", "_word"]).filter("getbit(_mask, cast(_row % 64 as int)) = 1").select(*rows.columns, *PLACE)


def copy_run(rows: DataFrame, marks: Marks, lake: Lake, run: int) -> None:
    """Write the marked ones of bronze ``rows``, read from a run's folder, as ``run``.

    Where no join deals them anew, a task holds the rows of the few files that it reads, and so of few buckets: it writes them without a shuffle.
    """
    kept = marked(rows, marks).drop(*PLACE)
    if marks.few:
        kept.write.partitionBy("bucket").mode("overwrite").parquet(f"{lake.path}/{BRONZE}/run={run}")
    else:
        write_run(kept, lake, BRONZE, run)


def _runs(spark: SparkSession, lake: Lake, table: str, schema: StructType, first: int, last: int, buckets: Sequence[int] | None = None) -> DataFrame:
    own = [f for f in schema if f.name not in ("run", "bucket")]
    whole = StructType([*own, StructField("run", IntegerType()), *([StructField("bucket", IntegerType())] if table in (BRONZE, "documents") else [])])
    if first > last or not exists(spark, f"{lake.path}/{table}"):
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(whole).parquet(f"{lake.path}/{table}").filter(F.col("run").between(first, last))
    return rows if buckets is None else rows.filter(F.col("bucket").isin(*buckets))


def run_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Archived records of the one run that lies at ``path``, whether it counts or not."""
    return spark.read.schema(StructType([*[f for f in schema if f.name not in ("run", "bucket")], StructField("bucket", IntegerType())])).parquet(path)


def archive(spark: SparkSession, lake: Lake, schema: StructType, buckets: Sequence[int] | None = None, after: int = 0) -> DataFrame:
    """Archived records of ``buckets`` (all if None), of runs after ``after``."""
    return _runs(spark, lake, BRONZE, schema, max(lake.first_bronze, after + 1), lake.bronze, buckets)


def held_documents(spark: SparkSession, lake: Lake, buckets: Sequence[int] | None = None) -> DataFrame:
    """(tenant_id, source_id, external_id, document_id) of every document of ``buckets``, some more than once."""
    shape = spark.createDataFrame([], "tenant_id string, source_id string, external_id string, document_id string").schema
    return _runs(spark, lake, "documents", shape, lake.first_silver, lake.silver, buckets).drop("run", "bucket")


def read_archive(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return archive(spark, open_lake(spark, path), schema).drop("run", "bucket")


def read_silver(spark: SparkSession, path: str) -> Silver:
    """The silver tables as of the last run that is whole: of each document the rows of the run that settled it last."""
    lake = open_lake(spark, path)
    replaced = _runs(spark, lake, "replaced", spark.createDataFrame([], "document_id string").schema, lake.first_silver + 1, lake.silver)
    latest = replaced.groupBy("document_id").agg(F.max("run").alias("_latest"))
    count = latest.count()

    def current(table: str) -> DataFrame:
        rows = _runs(spark, lake, table, spark.createDataFrame([], SHAPES[table]).schema, lake.first_silver, lake.silver)
        if count:
            hinted = F.broadcast(latest) if count <= BROADCAST_REPLACED else latest.hint("merge")
            rows = rows.join(hinted, "document_id", "left").filter(F.col("_latest").isNull() | (F.col("run") == F.col("_latest"))).drop("_latest")
        return rows.drop("run", "bucket")

    return Silver(*[current(table) for table in TABLES])


def compact(spark: SparkSession, path: str, schema: StructType, buckets: int | None = None) -> Lake:
    """Fold all runs into one, with another number of buckets if given. Replaced rows go; the old runs' folders stay until they are removed by hand.

    ``schema``: of the archived records.
    """
    lake = open_lake(spark, path)
    if lake.covered != lake.bronze:
        raise ValueError("settle the archive first: ingest an empty batch")
    new = lake._replace(buckets=buckets or lake.buckets, bronze=lake.bronze + 1, silver=lake.silver + 1)
    write_run(read_archive(spark, path, schema), new, BRONZE, new.bronze)
    for table, rows in zip(TABLES, read_silver(spark, path), strict=True):
        write_run(rows, new, table, new.silver)
    write_run(spark.createDataFrame([], "document_id string"), new, "replaced", new.silver)
    return commit(spark, new._replace(covered=new.bronze, first_bronze=new.bronze, first_silver=new.silver))
