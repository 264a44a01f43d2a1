"""Connected components of an edge table by contraction, in rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored


def join_summary(rows: DataFrame, summary: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with an aggregate of one row per ``key``.

    Joining on a changed key makes Spark exchange both sides for the join itself; on the aggregate's
    own partitioning, adaptive execution could not split the rows of a hot key over several tasks.
    """
    other = summary.withColumnRenamed(key, "_key").withColumn("_key", F.col("_key").bitwiseXOR(F.lit(1).cast("long")))
    joined = rows.join(other.hint("merge"), F.col(key).bitwiseXOR(F.lit(1).cast("long")) == F.col("_key"), how)
    return joined.drop("_key")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps: each node hangs its larger, then its smaller
    neighbours on the smallest one it knows, until the edge table no longer changes and is a star
    around every component's minimum. Minima are partial aggregates and the joins back may be split
    by key, so a node with very many edges needs no task of its own. Rounds grow with the logarithm
    of the longest path; each is written out. Empty input gives no rows; repeated edges and loops
    are harmless.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = stored(join_summary(both.filter("b > a"), low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        hung = F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))
        small = join_summary(large, low, "a").select(F.explode(hung).alias("e")).select("e.a", "e.b").filter("a != b")
        edges = stored(small.distinct(), "small-star")
        # done when all are stars: no node hangs on two, and none that hangs is a centre
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low")).filter("up > 1 or (up = 1 and low = 0)").limit(1).count():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
