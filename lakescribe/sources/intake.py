"""File-drop intake (SRC3): JSON files in one folder become channel candidates or error rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _candidate(element: Column) -> Column:
    """The first of url, handle and channel that is not empty; a string is itself."""
    fields = [F.nullif(F.try_variant_get(element, f"$.{name}", "string"), F.lit("")) for name in ("url", "handle", "channel")]
    is_object = F.schema_of_variant(element).startswith("OBJECT")
    is_text = F.schema_of_variant(element) == "STRING"
    return F.when(is_object, F.coalesce(*fields)).when(is_text, F.nullif(F.try_variant_get(element, "$", "string"), F.lit("")))


def parse_intake(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, errors) of (path, mtime, value): an array, or an object with an array "channels", of strings or objects."""
    parsed = files.withColumn("doc", F.try_parse_json("value"))
    shape = F.schema_of_variant("doc")
    listed = F.coalesce(F.try_variant_get("doc", "$.channels", "array<variant>"), F.when(shape.startswith("ARRAY"), F.try_variant_get("doc", "$", "array<variant>")))
    parsed = parsed.withColumn("elements", listed)
    whole = F.when(F.col("doc").isNull(), F.lit("not json")).when(F.col("elements").isNull(), F.lit("no list of channels"))
    bad_files = parsed.filter(whole.isNotNull()).select("path", "mtime", F.lit(None).cast("int").alias("pos"), whole.alias("error"))
    rows = parsed.filter(whole.isNull()).select("path", "mtime", F.posexplode("elements").alias("pos", "element")).withColumn("ref", _candidate(F.col("element")))
    bad_rows = rows.filter("ref is null").select("path", "mtime", "pos", F.lit("no url, handle or channel").alias("error"))
    return rows.filter("ref is not null").select("path", "mtime", "pos", "ref"), bad_files.unionByName(bad_rows)


def read_intake(spark: SparkSession, folder: str, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, errors) of the folder's .json files whose (path, mtime) is not in ``ledger``."""
    files = spark.read.text(f"{folder}/*.json", wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), "value")
    return parse_intake(files if ledger is None else files.join(ledger.select("path", "mtime"), ["path", "mtime"], "left_anti"))
