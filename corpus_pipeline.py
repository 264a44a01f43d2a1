"""The corpus pipeline: toxic documents go, of copies one stays, the sources are mixed, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it returns is
written as Parquet and read back as the next one's docs. All stages but the last keep the columns of
``documents``. After the mixing a document may occur several times.

In every stage a null text is the empty text, whole texts of any length count, rows with one id are documents of their own, columns that
the stage does not know pass through whatever their names, and an empty table stays empty.

Stages whose texts go through Python bound the bytes of the session's Arrow batches (``bound_batches``).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lakescribe.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from lakescribe.llm.queries import digests
from lakescribe.llm.scratch import bound_batches, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored under the threshold stay; the empty text has the bias's score, and without labels of both classes the base rate's."""
    bound_batches(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest stays, then the least id; empty texts equal each other, rows with one id share their fate."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the least id stays; texts without words are linked with nothing and stay."""
    return near_dedup.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate and a hash of its id say; a null source is a source, one without words gives nothing."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of ids and decoded bytes, a row per copy; the empty text has no ids."""
    bound_batches(spark)
    return digests(bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the toxicity model, similarity groups or BPE; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
