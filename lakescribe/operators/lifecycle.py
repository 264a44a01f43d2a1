"""Deleting a source or tenant with all that hangs on it (JN10, D11)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import fresh_folder

#: A reference: (child, column, parent, parent column, "cascade" or "set_null").
Reference = tuple[str, str, str, str, str]


def descendants(links: DataFrame, start: DataFrame, folder: str) -> DataFrame:
    """(key) of the rows that hang on ``start`` (key) by any number of ``links`` (key, parent), ``start`` included; semi-naive.

    A round joins only the keys that the last one found with the links, so its shuffle grows with what is deleted; rounds
    are as many as the longest chain. Every round is written. Cycles end, as known keys are no news.
    """
    spark = links.sparkSession
    links.filter("key is not null and parent is not null").distinct().write.parquet(f"{folder}/links")
    links = spark.read.schema(links.schema).parquet(f"{folder}/links")
    start.select("key").filter("key is not null").distinct().write.parquet(f"{folder}/found/round=0")
    shape, at = start.select("key").schema, 0
    while True:
        fresh = spark.read.schema(shape).parquet(f"{folder}/found/round={at}")
        found = spark.read.schema(shape).parquet(*[f"{folder}/found/round={i}" for i in range(at + 1)])
        if not fresh.limit(1).count():
            return found
        # all sides are written tables, so Spark knows their sizes
        hung = links.join(fresh.select(F.col("key").alias("parent")), "parent", "left_semi").select("key").distinct()
        at += 1
        hung.join(found, "key", "left_anti").write.parquet(f"{folder}/found/round={at}")


def cascade_purge(tables: dict[str, DataFrame], references: Sequence[Reference], root: str, doomed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(kept tables, counts): delete from ``root`` the rows whose key is in ``doomed``, and what references demand below.

    ``tables`` come parents first. Children of deleted rows are deleted, or their column is set to
    NULL. A table may refer to itself: what hangs on a deleted row by a chain of any length, or is in a cycle with it,
    goes too. Counts has (table_name, kept, deleted) per table. A table's rows are flagged
    by left joins with the keys of deleted parents, which are written level by level, so that no level
    computes those above it again; only a table that cascades to itself is read once more, for its keys.
    """
    spark, key, folder = doomed.sparkSession, doomed.columns[0], fresh_folder(doomed.sparkSession, "purge")
    gone: dict[str, DataFrame] = {}
    kept, counts = {}, []
    for name, table in tables.items():
        hits = [(c, action, gone[parent].select(F.col(k).alias(c))) for child, c, parent, k, action in references if child == name != parent and parent in gone]
        if name == root:
            hits.append((key, "cascade", doomed))
        own = [(c, k, action) for child, c, parent, k, action in references if child == name == parent]

        def flagged(hits: list, table: DataFrame = table) -> DataFrame:
            marked = table
            for at, (column, _, keys) in enumerate(hits):
                marked = marked.join(keys.distinct().withColumn(f"_hit{at}", F.lit(True)), column, "left")
            hit = {at: F.col(f"_hit{at}").isNotNull() for at in range(len(hits))}
            lost = reduce(or_, [hit[at] for at, (_, action, _) in enumerate(hits) if action == "cascade"], F.lit(False))
            cleared = {c: reduce(or_, [hit[at] for at, (column, action, _) in enumerate(hits) if action == "set_null" and column == c], F.lit(False)) for c in table.columns}
            return marked.select(*[F.when(~cleared[c], F.col(c)).alias(c) for c in table.columns], lost.alias("_gone"))

        for k in dict.fromkeys(k for _, k, _ in own):
            # parents' keys that go: those flagged so far, and what cascades from them within the table
            start = flagged(hits).filter("_gone").select(F.col(k).alias("key"))
            links = [table.select(F.col(k).alias("key"), F.col(c).alias("parent")) for c, other, action in own if other == k and action == "cascade"]
            if links:
                keys = descendants(reduce(DataFrame.unionByName, links), start, f"{folder}/{name}-{k}")
            else:
                start.distinct().write.parquet(f"{folder}/{name}-{k}")
                keys = spark.read.schema(start.schema).parquet(f"{folder}/{name}-{k}")
            hits = [*hits, *([(k, "cascade", keys.select(F.col("key").alias(k)))] if links else []), *[(c, "set_null", keys.select(F.col("key").alias(c))) for c, other, action in own if other == k and action == "set_null"]]
        final = flagged(hits)
        kept[name] = final.filter(~F.col("_gone")).drop("_gone")
        counts.append(final.agg(F.lit(name).alias("table_name"), F.count_if(~F.col("_gone")).alias("kept"), F.count_if("_gone").alias("deleted")))
        below = sorted({k for child, _, parent, k, _ in references if parent == name and child in tables and child != name})
        if below:
            final.filter("_gone").select(*below).write.parquet(f"{folder}/{name}")
            gone[name] = spark.read.schema(table.select(*below).schema).parquet(f"{folder}/{name}")
    return kept, reduce(DataFrame.unionByName, counts)


def purge_source(sources: DataFrame, tables: dict[str, DataFrame], references: Sequence[Reference], source_id, now: Column) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(sources, kept tables, log): content goes, the source row stays as a tombstone with status purged, and a log row has the counts."""
    doomed = sources.filter(F.col("source_id") == source_id)
    marked = sources.withColumn("status", F.when(F.col("source_id") == source_id, F.lit("purged")).otherwise(F.col("status")))
    kept, counts = cascade_purge({"source": doomed, **tables}, references, "source", doomed.select("source_id"))
    log = counts.filter("table_name != 'source'").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_name", "deleted")))).alias("deleted_rows"))
    kept.pop("source")
    return marked, kept, log.select(F.lit(source_id).alias("source_id"), now.alias("purged_at"), "deleted_rows")


def deprecate_source(sources: DataFrame, source_id, now: Column) -> DataFrame:
    """The source is hidden from retrieval; its rows are kept."""
    hit = F.col("source_id") == source_id
    return sources.withColumns({"status": F.when(hit, F.lit("deprecated")).otherwise(F.col("status")), "deprecated_at": F.when(hit, now).otherwise(F.col("deprecated_at"))})


def visible(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents of sources that are neither deprecated nor purged."""
    return documents.join(sources.filter("status = 'active'").select("source_id"), "source_id", "left_semi")
