"""Embedding whitening by a weighted covariance over distinct vectors (operator 13).

Vectors are taken in units of 1 / SCALE, rounded down to whole numbers x. Rows of equal x form one entry with
its multiplicity, which the covariance weighs by one or by the count; a hot vector is counted by partial
aggregates and costs one entry. The covariance is a matrix product per task over centred entries:
sums first (exact, in whole numbers), then products of what is left after the mean, then sums of the tasks'
matrices block by block. Its eigenvectors whiten every distinct vector once; rows get the result by a join on a
hash of x. The driver holds the matrix of dimension x dimension and nothing that grows with the rows.

Defined results: a vector that is null, empty, or holds a null or a non-finite entry is left out; so are
vectors of another dimension than the commonest (of several, the largest). A component without variance
(an eigenvalue under dimension x 2**-52 of the largest) has whitened NULL and explained 0, and no part in
identity_error, which is NULL without any. A deviation beyond 64 bits is NULL; entries of 2**62 / SCALE or more in size
are beyond whole numbers of 64 bits, and not meant. Repeated rows get equal
results each; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .scratch import stored

SCALE = 256
COMPONENTS = 4
#: Rows of a matrix that are summed as one block, and vectors that are centred at once.
ROWS_A_BLOCK, VECTORS = 64, 8192


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths, without nulls, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _keyed(scale: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = np.floor(batch.column(1).flatten().to_numpy(zero_copy_only=False) * scale).astype(np.int64), batch.column(1).value_lengths().to_numpy(zero_copy_only=False).cumsum()
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            keys = [hashlib.sha256(flat[a:b].tobytes()).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, flat)], names=["id", "key", "x"])

    return run


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, key, x) of the rows that count, written once; key is the SHA-256 of x."""
    finite = F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.coalesce(finite & (F.size(vector_col) > 0), F.lit(False))).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    shape = StructType([StructField("id", rows.schema["id"].dataType), StructField("key", BinaryType()), StructField("x", ArrayType(LongType()))])
    return stored(rows.mapInArrow(_keyed(scale), shape), "quantized")


@dataclass
class Moments:
    """What the vectors' distribution is: entries and weights, whole sums, covariance."""

    n: int
    sums: np.ndarray
    covariance: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean; the mean's whole part goes exactly."""
        whole = self.sums // self.n
        return (x - whole) - (self.sums - whole * self.n) / self.n


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, 0
    for batch in batches:
        if batch.num_rows:
            weights = batch.column(1).to_numpy()
            n, total = n + int(weights.sum()), total + (_matrix(batch.column(0)) * weights[:, None]).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total), dtype=np.int32)), pa.array(np.concatenate([[n], total]))], names=["at", "value"])


def _products(moments: Moments) -> Callable:
    """A task's sum of weight * centred * centred', as blocks of rows in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, seen = len(moments.sums), False
        total = np.zeros((d, d))
        for batch in batches:
            x, weights = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, d)), batch.column(1).to_numpy()
            for at in range(0, len(x), VECTORS):
                c = moments.centred(x[at : at + VECTORS])
                total += (c * weights[at : at + VECTORS, None]).T @ c
                seen = True
        if seen:
            starts = range(0, d, ROWS_A_BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([total[a : a + ROWS_A_BLOCK].tobytes() for a in starts], pa.binary())], names=["block", "part"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the parts of each block, in the order of their bytes so that reruns agree within a task's rows."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[block] = held.get(block, 0) + np.frombuffer(part)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["block", "part"])


def moments(entries: DataFrame) -> Moments | None:
    """Moments of entries (x, weight): two passes over a written table; None if there are none."""
    rows = entries.mapInArrow(_sums, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).collect()  # one row a dimension
    if not rows:
        return None
    values = {r["at"]: r["value"] for r in rows}
    found = Moments(values[-1], np.array([values[i] for i in range(len(values) - 1)], np.int64), np.zeros(0))
    parts = entries.mapInArrow(_products(found), "block int, part binary").repartition("block").sortWithinPartitions("block", "part").mapInArrow(_added, "block int, part binary")
    blocks = {r["block"]: np.frombuffer(r["part"]) for r in parts.collect()}  # the matrix, once
    total = np.concatenate([blocks[b] for b in sorted(blocks)]).reshape(len(found.sums), -1)
    found.covariance = (total + total.T) / (2 * found.n)
    return found


@dataclass
class Whitener:
    """Unit eigenvectors (columns), eigenvalues by falling size, and the share of the variance; NaN scale where there is none."""

    moments: Moments
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.moments.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of (n x - sums)^2, exact modulo 2**64, and where it fits into 63 bits."""
        n = self.moments.n
        apart = x * np.int64(n) - self.moments.sums  # modulo 2**64
        size = (self.moments.centred(x) ** 2).sum(axis=1) * float(n) ** 2
        return (apart * apart).sum(axis=1), size < 2.0**63 * (1 - 1e-9)


def fit(found: Moments, components: int = COMPONENTS) -> Whitener:
    values, vectors = np.linalg.eigh(found.covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    flat = values <= max(values[0], 0) * len(found.sums) * 2.0**-52
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)  # the largest entry is positive
    trace = np.trace(found.covariance)
    return Whitener(found, vectors, np.where(flat, np.nan, values), np.where(flat, 0, values / (trace or 1)))


def _whitened(whitener: Whitener) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                w, (deviation, fits) = whitener(x), whitener.deviation(x)
                offsets = np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]
                columns = [batch.column(0), pa.array(deviation, mask=~fits), pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), from_pandas=True)), batch.column(2)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "deviation", "w", "weight"])

    return run


def _identity_error(entries: DataFrame, components: int) -> float | None:
    """Largest entry of the whitened entries' covariance (centred, weighted) less the identity."""
    at = range(components)
    w = [F.col("w")[i] for i in at]
    means = entries.agg(F.sum("weight").alias("n"), *[(F.sum(w[i] * F.col("weight")) / F.sum("weight")).alias(f"m{i}") for i in at]).first()
    if not means["n"]:
        return None
    live = [i for i in at if means[f"m{i}"] is not None]
    if not live:
        return None
    products = [(F.sum((w[i] - means[f"m{i}"]) * (w[j] - means[f"m{j}"]) * F.col("weight")) / means["n"]).alias(f"c{i}_{j}") for i in live for j in live if i <= j]
    found = entries.agg(*products).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in live for j in live if i <= j)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, weights: str = "one", scale: int = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per row that counts and component.

    ``weights``: "one" fits over the distinct vectors, "count" over all rows. n is the weights' sum.
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights: {weights}")
    rows = quantized(vectors, id_col, vector_col, scale)
    size = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    rows = rows.filter(F.size("x") == F.lit(size))
    weight = F.count(F.lit(1)) if weights == "count" else F.any_value(F.lit(1).cast("long"))
    entries = stored(rows.groupBy("key", "x").agg(weight.alias("weight")), "distinct-vectors")
    found = moments(entries.select("x", "weight"))
    if found is None:
        head, names = rows.select(F.col("id").alias(id_col)).limit(0), ["component int", "n bigint", "deviation bigint", "whitened double", "explained double", "identity_error double"]
        return head.select("*", *[F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in names])
    whitener = fit(found, components)
    count = len(whitener.values)
    shape = "key binary, deviation long, w array<double>, weight long"
    white = stored(entries.select("key", "x", "weight").mapInArrow(_whitened(whitener), shape), "whitened")
    error = _identity_error(white, count)
    # both sides are written, so a vector that very many rows share is split over tasks
    joined = rows.select("id", "key").join(white.select("key", "deviation", "w").hint("merge"), "key")
    each = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), F.col("w")[i].alias("whitened"), F.lit(float(whitener.explained[i])).alias("explained")) for i in range(count)]))
    flat = joined.select("id", "deviation", each.alias("c"))
    return flat.select(F.col("id").alias(id_col), "c.component", F.lit(found.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
