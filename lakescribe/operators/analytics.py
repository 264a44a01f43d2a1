"""Declared analytics: duplicates, mentions, trends, retrieval, chunks, freshness, aliases, lineage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import fresh_folder
from .ingest import fan_out, normalized_items

#: Date precisions from fine to coarse.
PRECISION = ("exact", "date", "month", "year")
#: Query vectors are broadcast in blocks of this number.
BROADCAST_QUERIES = 10_000
#: Hidden sources that are broadcast at most.
BROADCAST_SOURCES = 1_000_000
#: Pairs of a query and a vector that a task scores at once, and those whose scores it checks at once.
PAIRS, CHECKED = 1 << 22, 1 << 16
#: More than the rounding error of a cosine.
SLACK = 1e-9


def rebuild(bronze: DataFrame):
    """(silver tables, rejected records) of all archived responses of all providers, by the same rules as the ingest."""
    items, rejects = normalized_items(bronze)
    return fan_out(items), rejects


def content_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(content_hash, keep_id, n) of texts that occur more than once; the smallest id stays."""
    hashed = docs.filter(F.col(text_col).isNotNull()).select(F.sha2(text_col, 256).alias("content_hash"), F.col(id_col).alias("_id"))
    return hashed.groupBy("content_hash").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def tallied(documents: DataFrame, *by: str) -> DataFrame | None:
    """Mentions and documents per (entity, *by) of rows that hold a document's mentions as ``entities``; None if a document has several rows.

    Mentions and then the distinct entities are expanded together and summed at once, so that no row a document and entity is
    shuffled or held: tasks hold sums, which are as many as entities.
    """
    if documents.groupBy("document").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        return None
    rows = documents.select(*by, "entities").select(*by, F.size("entities").alias("_n"), F.concat("entities", F.array_distinct("entities")).alias("_all"))
    every = rows.select(*by, "_n", F.posexplode("_all").alias("_pos", "entity"))
    return every.groupBy("entity", *by).agg(F.count_if(F.col("_pos") < F.col("_n")).alias("mentions"), F.count_if(F.col("_pos") >= F.col("_n")).alias("documents"))


def expanded(documents: DataFrame) -> DataFrame:
    """A row a mention, of rows with ``entities``."""
    return documents.select("*", F.explode("entities").alias("entity")).drop("entities")


def mention_counts(mentions: DataFrame, domain: str | None = None, cross_domain: bool = False, hidden: DataFrame | None = None) -> DataFrame:
    """D3: mentions and documents per (entity, domain); one domain unless ``cross_domain``; documents of ``hidden`` sources (domain's source_id) do not count.

    ``mentions`` has a row a mention (entity), or a row a document with all of its mentions (entities), which is cheaper.
    Of the former a count per (entity, document) comes first, so the distinct count needs no second expansion.
    """
    if not cross_domain:
        if domain is None:
            raise ValueError("name a domain, or ask for cross_domain")
        mentions = mentions.filter(F.col("domain") == domain)
    if hidden is not None:
        sources = hidden.select("source_id").distinct()
        mentions = mentions.join(F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources.hint("merge"), "source_id", "left_anti")
    if "entities" in mentions.columns:
        found = tallied(mentions, "domain")
        if found is not None:
            return found
        mentions = expanded(mentions)
    by_document = mentions.groupBy("entity", "domain", "document").agg(F.count(F.lit(1)).alias("_n"))
    return by_document.groupBy("entity", "domain").agg(F.sum("_n").alias("mentions"), F.count(F.lit(1)).alias("documents"))


def term_velocity(mentions: DataFrame, grain: str = "week", min_precision: str = "date") -> DataFrame:
    """Mentions per (entity, domain, bucket of published_at), and the change from the bucket before that has any; dates too coarse do not count."""
    fine = PRECISION[: PRECISION.index(min_precision) + 1]
    counted = mentions.filter(F.col("precision").isin(*fine) & F.col("published_at").isNotNull())
    counted = counted.groupBy("entity", "domain", F.date_trunc(grain, "published_at").alias("bucket")).agg(F.count(F.lit(1)).alias("mentions"))
    before = F.lag("mentions").over(Window.partitionBy("entity", "domain").orderBy("bucket"))
    return counted.withColumn("change", F.col("mentions") - before)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row products, summed from left to right."""
    return np.cumsum(a * b, axis=1)[:, -1]


def _scored(batch: pa.RecordBatch, rows: np.ndarray, starts: np.ndarray, flat: np.ndarray, ids: pa.Array, q: np.ndarray, squares: np.ndarray, floor: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of ``rows`` per query that can still be among the best of all; raises ``floor``.

    A matrix product finds the candidates, rows within SLACK of the k-th best so far. Their scores are then
    summed from left to right, so that equal vectors have equal scores wherever they stand.
    """
    v = flat[starts[rows][:, None] + np.arange(q.shape[1])]
    own = _dots(v, v)
    rows, v, own = rows[own > 0], v[own > 0], own[own > 0]
    near = (v / np.sqrt(own)[:, None]) @ (q / np.sqrt(squares)[:, None]).T
    if len(rows) >= k:
        np.maximum(floor, np.partition(near, len(rows) - k, axis=0)[len(rows) - k] - SLACK, out=floor)
    row, query = np.nonzero(near >= floor)
    score = np.empty(len(row))
    for p in range(0, len(row), CHECKED):
        i, j = row[p : p + CHECKED], query[p : p + CHECKED]
        score[p : p + CHECKED] = _dots(q[j], v[i]) / np.sqrt(squares[j] * own[i])
    vec_ids = batch.column(0).take(pa.array(rows[row]))
    rank = np.empty(len(row), np.int64)
    rank[pc.array_sort_indices(vec_ids).to_numpy()] = np.arange(len(row))
    order = np.lexsort((rank, -score, query))
    place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    order = order[place < k]
    columns = [ids.take(pa.array(query[order])), vec_ids.take(pa.array(order)), pa.array(score[order])]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])


def _best(k: int, blocks):
    """A task's part of ``vector_topk``: per batch and query at most k rows that can still be among the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(ids, q, _dots(q, q)) for ids, q in blocks.value]
        floors = [np.full(len(q), -np.inf) for _, q, _ in ready]
        for batch in batches:
            starts, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            for (ids, q, squares), floor in zip(ready, floors, strict=True):
                fit = np.flatnonzero(np.diff(starts) == q.shape[1])
                step = max(1, PAIRS // len(q))
                for at in range(0, len(fit), step):
                    yield _scored(batch, fit[at : at + step], starts, flat, ids, q, squares, floor, k)

    return run


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k vectors of highest cosine per query (query_id, q) among (vec_id, v), ties by vec_id; exact.

    Queries meet all vectors in blocks of BROADCAST_QUERIES at most: a block is broadcast as a matrix, and each
    task keeps k rows per query and batch before anything is shuffled. Several blocks run one after the other,
    each over all vectors, and their rows are written before they are ranked together. Vectors that are NULL,
    hold a NULL, have no length, or have another dimension than the query have no cosine and are in no result.
    """
    spark, order = queries.sparkSession, Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    whole = lambda c: F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull()) & (F.size(c) > 0)
    targets = vectors.filter(whole("v")).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    id_type = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "vec_id"))}

    def best(block: DataFrame) -> DataFrame:
        rows = block.filter(whole("q")).select("query_id", F.col("q").cast("array<double>").alias("q")).toArrow()
        sized: dict[int, list[int]] = {}
        values = [np.array(q) for q in rows["q"].to_pylist()]
        for at, q in enumerate(values):
            if q.any():
                sized.setdefault(len(q), []).append(at)
        matrices = [(rows["query_id"].take(part).combine_chunks(), np.array([values[at] for at in part])) for part in sized.values()]
        return targets.mapInArrow(_best(k, spark.sparkContext.broadcast(matrices)), f"query_id {id_type['query_id']}, vec_id {id_type['vec_id']}, score double")

    def ranked(scored: DataFrame) -> DataFrame:
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    if queries.count() <= BROADCAST_QUERIES:
        return ranked(best(queries))
    path = fresh_folder(spark, "topk")
    queries.select("query_id", "q", F.monotonically_increasing_id().alias("_at")).write.parquet(f"{path}/queries")
    numbered = spark.read.parquet(f"{path}/queries")
    # a number is its partition's number times 2^33, and the place in the partition
    parts = sorted((r["_part"], r["n"]) for r in numbered.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect())
    firsts, before = [], 0
    for part, n in parts:
        firsts += [(part << 33) + at for at in range(-before % BROADCAST_QUERIES, n, BROADCAST_QUERIES)]
        before += n
    for first, end in zip(firsts, [*firsts[1:], 1 << 62], strict=True):
        block = numbered.filter((F.col("_at") >= first) & (F.col("_at") < end)).drop("_at")
        ranked(best(block)).drop("rank").write.mode("append").parquet(f"{path}/best")
    return ranked(spark.read.parquet(f"{path}/best"))


class Cells(NamedTuple):
    """Vectors (vec_id, v, cell, angle) written by cell: that of the pivot of smallest angle. ``stats``: cell -> (least angle, largest, vectors)."""

    path: str
    pivots: np.ndarray
    stats: dict[int, tuple[float, float, int]]


#: Angles may be off by rounding near 0 and pi, where the cosine is flat.
ANGLE_SLACK = 1e-6


def vector_cells(vectors: DataFrame, pivots: int = 256) -> Cells:
    """Cells of (vec_id, v) around ``pivots`` vectors that a hash of the id picks; vectors of another dimension than theirs are in cell -1."""
    spark, path = vectors.sparkSession, fresh_folder(vectors.sparkSession, "cells")
    whole = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()) & (F.size("v") > 0) & F.exists("v", lambda x: x != 0)
    rows = vectors.filter(whole).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    picked = [np.array(r["v"]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]
    size = len(picked[0]) if picked else 0
    own = np.array([p for p in picked if len(p) == size]) if size else np.zeros((0, 0))
    own = own / np.linalg.norm(own, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(own)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            fit = np.flatnonzero(np.diff(starts) == size)
            cell, angle = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            v = flat[starts[fit][:, None] + np.arange(size)]
            near = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ shared.value.T
            cell[fit], angle[fit] = near.argmax(axis=1), np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle)], names=["vec_id", "v", "cell", "angle"])

    placed = rows.mapInArrow(assign, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v array<double>, cell int, angle double") if size else rows.select("*", F.lit(-1).alias("cell"), F.lit(0.0).alias("angle"))
    placed.write.parquet(f"{path}/placed")
    # by ranges of cell and angle, so that a cell with very many vectors is several tasks
    spark.read.parquet(f"{path}/placed").repartitionByRange("cell", "angle").sortWithinPartitions("cell").write.parquet(f"{path}/cells")
    stats = spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.min("angle"), F.max("angle"), F.count(F.lit(1))).collect()  # a row a pivot
    return Cells(f"{path}/cells", own, {r[0]: (r[1], r[2], r[3]) for r in stats})


def _in_cells(k: int, block):
    """A task's part of ``pruned_topk``: each cell's rows meet the queries that are open for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, open_, floor = block.value
        squares, floor = _dots(q, q), floor.copy()
        for batch in batches:
            starts, flat, cells = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(), batch.column(2).to_numpy()
            for cell in np.unique(cells):
                asked = open_.get(int(cell))
                if asked is None:
                    continue
                fit = np.flatnonzero((cells == cell) & (np.diff(starts) == q.shape[1]))
                step = max(1, PAIRS // len(asked))
                for at in range(0, len(fit), step):
                    part = floor[asked]
                    yield _scored(batch, fit[at : at + step], starts, flat, ids.take(pa.array(asked)), q[asked], squares[asked], part, k)
                    floor[asked] = part

    return run


def pruned_topk(queries: DataFrame, cells: Cells, k: int) -> tuple[DataFrame, float]:
    """D5 over cells: (result of ``vector_topk``, share of all pairs of a query and a vector that were scored); exact.

    A vector of a cell with angles lo to hi from its pivot is at least max(angle - hi, lo - angle) from a query at ``angle`` from
    the pivot. A first pass scores each query in its nearest cells, up to k vectors, and so learns what the k-th
    best is at least; a second one reads the cells, and scores the pairs, that can still reach it. Queries are of the pivots' dimension,
    BROADCAST_QUERIES at most: others are for ``vector_topk``.
    """
    spark = queries.sparkSession
    whole = F.col("q").isNotNull() & F.forall("q", lambda x: x.isNotNull()) & F.exists("q", lambda x: x != 0)
    table = spark.read.parquet(cells.path)
    shape = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {table.schema['vec_id'].dataType.simpleString()}, score double"
    if not cells.stats or not queries.filter(whole).limit(1).count():
        return spark.createDataFrame([], f"{shape}, rank int"), 0.0
    if queries.count() > BROADCAST_QUERIES or queries.filter(whole & (F.size("q") != cells.pivots.shape[1])).limit(1).count():
        raise ValueError("too many queries for one block, or of another dimension")
    rows = queries.filter(whole).select("query_id", F.col("q").cast("array<double>").alias("q")).toArrow()
    ids, q = rows["query_id"].combine_chunks(), np.array(rows["q"].to_pylist())
    numbers, sizes = sorted(cells.stats), np.array([cells.stats[c][2] for c in sorted(cells.stats)])
    low, high = (np.array([cells.stats[c][i] for c in numbers]) for i in (0, 1))
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    angle = np.stack([np.arccos(np.clip(unit @ cells.pivots[c], -1, 1)) if c >= 0 else np.zeros(len(q)) for c in numbers], axis=1)
    least = np.maximum(0, np.maximum(angle - high, low - angle)) - ANGLE_SLACK
    reach = np.where(least > 0, np.cos(np.clip(least, 0, np.pi)), 1.0) + ANGLE_SLACK  # the best cosine that a cell may hold
    reach[:, [i for i, c in enumerate(numbers) if c < 0]] = -np.inf  # of another dimension

    def passed(asked: np.ndarray, floor: np.ndarray, name: str) -> DataFrame:
        open_ = {c: np.flatnonzero(asked[:, i]) for i, c in enumerate(numbers) if asked[:, i].any()}
        block = spark.sparkContext.broadcast((ids, q, open_, floor))
        found = table.filter(F.col("cell").isin(list(open_))).select("vec_id", "v", "cell").mapInArrow(_in_cells(k, block), shape)
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
        path = fresh_folder(spark, name)
        ranked.write.parquet(path)
        return spark.read.parquet(path)

    nearest = np.argsort(np.where(np.isinf(reach), np.inf, angle), axis=1, kind="stable")
    before = np.cumsum(sizes[nearest], axis=1) - sizes[nearest]
    first = np.zeros_like(reach, bool)
    np.put_along_axis(first, nearest, before < k, axis=1)
    first &= ~np.isinf(reach)
    one = passed(first, np.full(len(q), -np.inf), "nearest-cells")
    known = {r["query_id"]: r["score"] for r in one.filter(F.col("rank") == k).collect()}  # one number a query
    floor = np.array([known.get(i, -np.inf) for i in ids.to_pylist()]) - SLACK
    rest = (reach >= floor[:, None]) & ~first & ~np.isinf(reach)
    best = one.unionByName(passed(rest, floor, "open-cells")) if rest.any() else one
    share = float(((first | rest) * sizes).sum() / (len(q) * sizes.sum()))
    return best.drop("rank").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k), share


def swap_version(df: DataFrame, path: str, version: str) -> None:
    """Write a model version beside the others, then append a pointer to it; readers take the latest pointer.

    Nothing is overwritten but the version's own partition, so a crash leaves the version that was active before.
    """
    spark = df.sparkSession
    df.withColumn("model_version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_version").parquet(f"{path}/vectors")
    pointers = f"{path}/active"
    last = spark.read.parquet(pointers).agg(F.max("at")).first()[0] if _exists(spark, pointers) else 0
    spark.range(1).select(F.lit(last + 1).alias("at"), F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(pointers)


def _exists(spark, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def active_vectors(spark, path: str) -> DataFrame:
    version = spark.read.parquet(f"{path}/active").agg(F.max_by("version", "at")).first()[0]
    return spark.read.parquet(f"{path}/vectors").filter(F.col("model_version") == version)


def chunk_segments(segments: DataFrame, max_tokens: int = 400, key: str = "document", speaker: str = "speaker", idx: str = "idx") -> DataFrame:
    """Chunks of consecutive segments of one speaker: (key, chunk, speaker, first_idx, last_idx, token_count, text, start_ms, end_ms).

    ``segments`` has offset_ms and duration_ms; a chunk runs from its first segment's start to its last one's end.

    Within a speaker's island a segment goes to window floor((tokens before it) / max_tokens), so a
    chunk starts below each multiple of max_tokens and no segment is cut. Documents are independent.
    """
    order = Window.partitionBy(key).orderBy(idx)
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    marked = segments.withColumn("_tokens", tokens).withColumn("_turn", (~F.col(speaker).eqNullSafe(F.lag(speaker).over(order))).cast("int"))
    marked = marked.withColumn("_turn", F.when(F.row_number().over(order) == 1, 1).otherwise(F.col("_turn")))
    islands = marked.withColumn("_island", F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(key, "_island").orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    packed = islands.withColumn("_window", F.floor(F.coalesce(F.sum("_tokens").over(before), F.lit(0)) / max_tokens))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(idx, "text"))), lambda s: s["text"]), " ")
    chunks = packed.groupBy(key, "_island", "_window").agg(F.first(speaker).alias(speaker), F.min(idx).alias("first_idx"), F.max(idx).alias("last_idx"), F.sum("_tokens").alias("token_count"), texts.alias("text"), F.min("offset_ms").alias("start_ms"), F.max(F.col("offset_ms") + F.col("duration_ms")).alias("end_ms"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("first_idx")) - 1
    return chunks.withColumn("chunk", number).drop("_island", "_window")


def crossed_over(mentions: DataFrame, a: str, b: str) -> DataFrame:
    """Entities seen in domain ``a`` before domain ``b``, with both first times; one aggregation, no self-join."""
    first = lambda d: F.min(F.when(F.col("domain") == d, F.col("published_at")))
    seen = mentions.groupBy("entity").agg(first(a).alias("first_a"), first(b).alias("first_b"))
    return seen.filter("first_a < first_b")


def stale_flows(expected: DataFrame, heartbeat: DataFrame, now: Column, max_age_hours: int) -> DataFrame:
    """Expected flows without a heartbeat in time; never_run tells those that have none at all."""
    last = heartbeat.groupBy("tenant_id", "flow_name").agg(F.max("last_success_at").alias("last_success_at"))
    joined = expected.join(last.hint("merge"), ["tenant_id", "flow_name"], "left").withColumn("never_run", F.col("last_success_at").isNull())
    return joined.filter(F.col("never_run") | (F.col("last_success_at") < now - F.make_interval(hours=F.lit(max_age_hours))))


def _grams(text: Column) -> Column:
    """Distinct 3-grams of the lower-cased text, padded by two spaces before and one after."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3)))


def alias_match(surfaces: DataFrame, aliases: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(surface, alias, similarity) with shared 3-grams / all 3-grams at least ``threshold``.

    Only the rarest 3-grams of each string are joined on (a prefix filter): strings of m grams that
    reach the threshold t share one of the first m - ceil(t * m) + 1 in any common order, and their numbers of grams
    are within the factor t. Exact.
    """

    def grams(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(name)).distinct().filter(F.col(name).isNotNull()).withColumn("g", _grams(F.col(name))).withColumn("m", F.size("g"))

    left, right = grams(surfaces, "surface"), grams(aliases, "alias")
    counts = left.select(F.explode("g").alias("gram")).union(right.select(F.explode("g").alias("gram"))).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        ranked = df.select(name, "m", F.explode("g").alias("gram")).join(counts.hint("merge"), "gram").groupBy(name).agg(F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("o"))
        first = F.slice("o", F.lit(1), (F.col("m") - F.ceil(F.col("m") * threshold - 1e-9) + 1).cast("int"))
        return ranked.select(name, F.col("m").alias(f"m_{name}"), F.explode(F.transform(first, lambda s: s["gram"])).alias("gram"))

    own, other = prefix(left, "surface"), prefix(right, "alias")
    near = F.least("m_surface", "m_alias") >= F.greatest("m_surface", "m_alias") * threshold - 1e-9
    pairs = own.join(other.hint("merge"), (own["gram"] == other["gram"]) & near).select("surface", "alias").distinct()
    full = pairs.join(left.select("surface", F.col("g").alias("ga")).hint("merge"), "surface").join(right.select("alias", F.col("g").alias("gb")).hint("merge"), "alias")
    shared = F.size(F.array_intersect("ga", "gb"))
    similarity = shared / (F.size("ga") + F.size("gb") - shared)
    return full.select("surface", "alias", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)


def lineage(versions: DataFrame, id_col: str = "transcript_id", parent_col: str = "derived_from_id", columns: Sequence[str] = ("text",)) -> DataFrame:
    """Derived versions beside their parents; a parent that is missing leaves NULLs."""
    parents = versions.select(F.col(id_col).alias(parent_col), *[F.col(c).alias(f"parent_{c}") for c in columns])
    return versions.filter(F.col(parent_col).isNotNull()).join(parents, parent_col, "left")


def lineage_roots(versions: DataFrame, id_col: str = "transcript_id", parent_col: str = "derived_from_id") -> DataFrame:
    """(id, root, depth) of every version: the oldest version that is there on its chain of parents, and the steps to it.

    By pointer jumping: in each round an unfinished version takes over where its pointer points, so rounds are the logarithm of the
    longest chain. A round in which none finishes has only cycles, and what hangs on them, left: their root and depth are NULL. Ids
    are unique and not NULL. Every round writes all pointers; joins are by id, over written tables, so that a parent of very many
    versions is split over tasks.
    """
    spark, folder = versions.sparkSession, fresh_folder(versions.sparkSession, "lineage")
    ids = versions.select(F.col(id_col).alias("up"), F.lit(True).alias("_there"))
    slim = versions.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up")).join(ids.hint("merge"), "up", "left")
    top = F.coalesce(F.col("_there"), F.lit(False)) == F.lit(False)
    slim.select("id", F.when(top, F.col("id")).otherwise(F.col("up")).alias("up"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), top.alias("done")).write.parquet(f"{folder}/round=0")
    at, left = 0, None
    while True:
        now = spark.read.parquet(f"{folder}/round={at}")
        before, left = left, now.filter("not done").count()
        if not left or left == before:
            return now.select(F.col("id").alias(id_col), F.when(F.col("done"), F.col("up")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))
        there = now.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        open_ = now.filter("not done").join(there.hint("merge"), F.col("up") == F.col("_id"))
        jumped = open_.select("id", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        at += 1
        now.filter("done").unionByName(jumped).write.parquet(f"{folder}/round={at}")
