"""MinHash near-dedup with HyperMinHash registers (operator 1).

A document is its set of distinct ``SHINGLE``-word shingles (64-bit hashes). Its sketch deals the
hashes into ``BUCKETS`` buckets and keeps of each bucket's minimum the leading-zero count (6 bits)
and the ``MANTISSA`` bits after it: 16 bits a register.

1. Documents with equal sets form a class; one of each class goes on.
2. Banding: the registers are cut into bands and hashed; documents that share a band may be linked.
   Small sets get fewer and wider bands (``LEVELS``), else a band would hold a shingle or two and
   group everything that shares a common phrase. Linked sets of size n differ in 0.15 / 0.85 * n
   shingles at most; up to 127 that is fewer than there are bands, so one band at least is untouched.
   (It may be empty; sets of fewer than ``ALWAYS_FILTERED`` shingles, where that is likely, all take part in step 4.)
   From 128 on there are 42 bands of 6, which a link misses with probability (1 - 0.85**6)**42, some
   2e-9. Sizes near a level's edge get the bands of both levels.
3. In each band group, the member that shares most bands with others is the pivot: all members are
   compared with it, and links merge them. A large group of near copies so costs rows in proportion to its size.
4. Links between members that no pivot has merged are found exactly by an ordered prefix filter: in
   every set the shingles are sorted from rare to frequent, by exact counts over all sets, and two
   sets of sizes n and m with overlap o or more, o = 0.85 / 1.85 * (n + m), share one of their first
   n - o + 1 and m - o + 1 shingles. Shingles of one set only come first and make no pair, so most
   sets have no row here. Pairs come from shared early shingles, of sets that are not merged yet.
5. Before a pair is verified, its similarity is estimated from the registers, less the agreement that
   HyperMinHash expects by chance; only pairs ``MARGIN`` standard deviations or more below the
   threshold are dropped.
6. Verification: exact intersection and union of the two full sets.

Words are runs without white space after lower-casing A-Z; a text with fewer words than a shingle
is one shingle of all its words. Defined results: null, empty and blank texts have an empty set and
are linked with nothing; an empty table gives no rows; rows with the same id and set are one
document; extra columns of any name are ignored (``dedup`` keeps them). A text's set is held whole, so
memory is in proportion to the longest text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, join_summary
from .scratch import bound_batches, stored
from .tokens import chunks, mix64, shingle_hashes

SHINGLE = 5
BUCKETS, MANTISSA = 256, 10
#: Smallest set size of each level, and its number of bands. Smaller sets link with equal ones only.
LEVELS = ((6, 2), (8, 3), (16, 6), (32, 12), (64, 23), (128, 42))
ALWAYS_FILTERED = 32
#: Ids of documents in groups are broadcast up to this number (8 bytes each), beyond it joined.
BROADCAST_IDS = 500_000
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 85
MARGIN = 6.0

SKETCH = "doc_id long, n long, d1 long, d2 long, registers binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, sorted distinct shingle hashes of all texts one after the other, each text's first)."""
    for batch in batches:
        for chunk in chunks(batch.column(1), lower=True):
            starts, ends, first = chunk.words()
            hashes, at = shingle_hashes(chunk.hashes(starts, ends), first, SHINGLE)
            for a, b in zip(at, at[1:]):  # noqa: B905
                hashes[a:b].sort()
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            new[at[:-1][at[:-1] < len(hashes)]] = True
            upto = np.concatenate([[0], np.cumsum(new)])
            yield batch.column(0).slice(chunk.first, len(chunk)), hashes[new], upto[at]


def _float_bits(low: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits, 1 at least) and MANTISSA bits of 56-bit numbers; order is reversed: small numbers get large registers."""
    exponent = np.frexp(low.astype(np.float64))[1].astype(np.int64)  # bits in use
    over = low >> np.maximum(exponent, 0).astype(np.uint64) != 0  # rounded down by the cast
    exponent += over
    exponent -= (exponent > 0) & ((low >> np.maximum(exponent - 1, 0).astype(np.uint64)) == 0)
    zeros = 57 - exponent
    shift = exponent - 1 - MANTISSA
    mantissa = np.where(shift >= 0, low >> np.maximum(shift, 0).astype(np.uint64), low << np.maximum(-shift, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | (np.uint16((1 << MANTISSA) - 1) - mantissa.astype(np.uint16))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, hashes, at in _sets(batches):
        counts = np.diff(at)
        text = np.repeat(np.arange(len(counts)), counts)
        bucket = (hashes >> np.uint64(56)).astype(np.int64)
        cell = text * BUCKETS + bucket
        lowest = np.ones(len(cell), bool)  # the hashes of a text are sorted, so a bucket's first is its minimum
        lowest[1:] = cell[1:] != cell[:-1]
        registers = np.zeros(len(counts) * BUCKETS, np.uint16)
        registers[cell[lowest]] = _float_bits(hashes[lowest] & np.uint64((1 << 56) - 1))
        sums = []
        for salt in (0x51ED270B, 0x2545F491):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes + np.uint64(salt)))])
            sums.append(pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)))
        rows = registers.reshape(-1, BUCKETS)
        yield pa.RecordBatch.from_arrays([ids, pa.array(counts.astype(np.int64)), *sums, pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "n", "d1", "d2", "registers"])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, d1, d2, registers): set size, 128-bit digest of the set, 16-bit registers."""
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(_sketch, SKETCH)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, members): the full sets of (doc_id, text), sorted 64-bit hashes as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, at in _sets(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([hashes[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["doc_id", "members"])  # noqa: B905

    return docs.mapInArrow(run, "doc_id long, members binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint16).reshape(-1, BUCKETS)


def _bands(level: int) -> np.ndarray:
    """First register of each band of a level, and the end of the last."""
    count = LEVELS[level][1]
    width, wider = (6, 0) if level == len(LEVELS) - 1 else divmod(BUCKETS, count)
    return np.cumsum([0, *[width + (i < wider) for i in range(count)]])


def band_keys(sketched: DataFrame) -> DataFrame:
    """(key, doc_id, n): a row for each band of each document that has a register in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = mix64(np.arange(7, 7 + BUCKETS, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            if not len(batch):
                continue
            sizes, registers = batch.column(1).to_numpy(), _matrix(batch.column(2))
            for level, (least, _) in enumerate(LEVELS):
                above = LEVELS[level + 1][0] if level + 1 < len(LEVELS) else np.inf
                rows = np.flatnonzero((100 * sizes >= PERCENT * least) & (PERCENT * sizes < 100 * above) & (sizes >= LEVELS[0][0]))
                if not len(rows):
                    continue
                cuts = _bands(level)
                own = registers[rows]
                products = own[:, : cuts[-1]] * weights[: cuts[-1]]
                keys = mix64(np.add.reduceat(products, cuts[:-1], axis=1) + mix64(np.arange(len(cuts) - 1, dtype=np.uint64) + np.uint64(64 * level)))
                row, band = np.nonzero(np.add.reduceat((own[:, : cuts[-1]] > 0).astype(np.int64), cuts[:-1], axis=1))
                at = pa.array(rows[row])
                yield pa.RecordBatch.from_arrays([pa.array(keys[row, band].view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "doc_id", "n"])

    return sketched.select("doc_id", "n", "registers").mapInArrow(run, "key long, doc_id long, n long")


def shingle_rows(sets: DataFrame) -> DataFrame:
    """(doc_id, shingle): a row for each member of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 64):
                members = [x.as_py() for x in batch.column(1).slice(a, 64)]
                row = pa.array(np.repeat(np.arange(len(members)), [len(m) // 8 for m in members]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 64).take(row), pa.array(np.frombuffer(b"".join(members), np.int64))], names=["doc_id", "shingle"])

    return sets.select("doc_id", "members").mapInArrow(run, "doc_id long, shingle long")


def prefixes(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(shingle, doc_id, n, at): the rarest shingles of each set that a link may need, and their places from 1.

    A shingle of one set only makes no pair, but keeps its place. Counts are partial aggregates, and
    they are written, so that adaptive execution can split the rows of a frequent shingle in the join.
    """
    rows = shingle_rows(sets)
    counts = stored(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "shingle-counts")
    own = Window.partitionBy("doc_id")
    shared = rows.join(counts.hint("merge"), "shingle").withColumns({"_place": F.row_number().over(own.orderBy("c", "shingle")), "_shared": F.count(F.lit(1)).over(own)})
    placed = shared.join(sizes.select("doc_id", "n").hint("merge"), "doc_id").withColumn("at", F.col("n") - F.col("_shared") + F.col("_place"))
    return placed.filter(F.col("at") <= F.col("n") - F.ceil(PERCENT * F.col("n") / F.lit(100.0) - 1e-9) + 1).select("shingle", "doc_id", "n", "at")


def agreement_by_chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Expected share of the filled buckets in which the minima of two disjoint sets get the same register.

    A bucket holds n / BUCKETS hashes, so its minimum has density a * exp(-a x), a being that load. A
    register is a cell of width 2**-(zeros + MANTISSA); the product of both densities, summed over the
    cells of each number of leading zeros, is an integral over [2**-zeros, 2**(1 - zeros)).
    """
    a, b = np.maximum(n_a, 1) / BUCKETS, np.maximum(n_b, 1) / BUCKETS
    edges = np.exp(-np.multiply.outer(a + b, 2.0 ** -np.arange(57)))
    octaves = (edges[:, 1:] - edges[:, :-1]) @ (2.0 ** -(np.arange(1, 57) + MANTISSA))
    return octaves * a * b / (a + b) / -np.expm1(-(a + b))


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose estimated similarity is not clearly below the threshold."""
    for batch in batches:
        if not len(batch):
            continue
        a, b = _matrix(batch.column(4)), _matrix(batch.column(5))
        filled = ((a != 0) | (b != 0)).sum(axis=1)
        share = ((a == b) & (a != 0)).sum(axis=1) / np.maximum(filled, 1)
        chance = agreement_by_chance(batch.column(2).to_numpy(), batch.column(3).to_numpy())
        similarity = (share - chance) / (1 - chance)
        wanted = PERCENT / 100
        keep = similarity >= wanted - MARGIN * np.sqrt(wanted * (1 - wanted) / np.maximum(filled, 1))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs that the full sets link."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):  # noqa: B905
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= PERCENT * (len(both) - common))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


def _linked(pairs: DataFrame, sketched: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of (a, b) that are links: the estimate first, then the full sets."""
    with_a = pairs.join(_renamed(sketched, a="doc_id", na="n", ra="registers").hint("merge"), "a")
    with_both = with_a.join(_renamed(sketched, b="doc_id", nb="n", rb="registers").hint("merge"), "b")
    likely = with_both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimate, "a long, b long")
    full = likely.join(_renamed(sets, a="doc_id", sa="members").hint("merge"), "a").join(_renamed(sets, b="doc_id", sb="members").hint("merge"), "b")
    return stored(full.select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long"), "links")


def _pivot_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every member of a band group with the group's pivot."""
    weight = members.groupBy("doc_id").agg(F.sum("size").alias("weight"))
    pivots = members.join(weight.hint("merge"), "doc_id").groupBy("key").agg(F.max(F.struct("weight", -F.col("doc_id"), "n")).alias("p"))
    pivots = pivots.select("key", (-F.col("p.col2")).alias("pivot"), F.col("p.n").alias("pn"))
    pairs = join_summary(members, pivots, "key").filter((F.col("doc_id") != F.col("pivot")) & (100 * F.least("n", "pn") >= PERCENT * F.greatest("n", "pn")))
    return pairs.select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct()


def _prefix_pairs(sets: DataFrame, sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b) not merged by ``labels`` that may be links.

    Of a shingle's rows, those outside its most frequent component meet all others of near sizes; a shingle of one component meets none.
    """
    rows = prefixes(sets, sizes).join(_renamed(labels, doc_id="node", label="component").hint("merge"), "doc_id", "left")
    rows = stored(rows.withColumn("label", F.coalesce("label", "doc_id")), "prefixes")
    main = rows.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("shingle").agg(F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("labels"))
    main = main.filter("labels > 1").select("shingle", F.col("m.label").alias("main"))
    rows = stored(join_summary(rows, main, "shingle"), "open-prefixes")
    # linked sizes lie within a band of each other, so rows of a shingle meet those of near sizes only
    band = F.floor(F.log("n") / -math.log(PERCENT / 100 - 0.001))
    left = rows.filter("label != main").select("shingle", F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.col("label").alias("lx"))
    right = rows.select("shingle", band.alias("band_y"), F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"), F.col("label").alias("ly"), (F.col("label") == F.col("main")).alias("in_main"))
    overlap = F.ceil(PERCENT * (F.col("nx") + F.col("ny")) / F.lit(100 + PERCENT) - 1e-9)
    fits = (
        (F.col("lx") != F.col("ly")) & (F.col("in_main") | (F.col("x") < F.col("y"))) & (100 * F.least("nx", "ny") >= PERCENT * F.greatest("nx", "ny"))
        & (F.col("ax") <= F.col("nx") - overlap + 1) & (F.col("ay") <= F.col("ny") - overlap + 1)
    )
    renamed = right.withColumnRenamed("shingle", "shingle_y")
    pairs = left.join(renamed.hint("merge"), (F.col("shingle") == F.col("shingle_y")) & (F.col("band") == F.col("band_y")) & fits)
    return stored(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "prefix-pairs")


def _grouped(docs: DataFrame, ids: DataFrame, few: bool) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among the distinct ``ids``."""
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_semi")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row."""
    bound_batches(docs.sparkSession)
    every = stored(sketches(docs, id_col, text_col), "sketches")
    slim = every.select("doc_id", "n", "d1", "d2")
    # equal sets have equal registers
    classes = every.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.any_value("registers").alias("registers"))
    classes = stored(classes, "classes")

    bands = band_keys(classes)
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(join_summary(bands, sizes, "key"), "members")
    small = classes.filter((F.col("n") >= LEVELS[0][0]) & (F.col("n") < ALWAYS_FILTERED))
    ids = stored(members.select("doc_id").union(small.select("doc_id")).distinct(), "grouped-ids")
    few = ids.count() <= BROADCAST_IDS
    sketched = stored(_grouped(classes.select("doc_id", "n", "registers"), ids, few), "grouped-sketches")
    texts = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    sets = stored(shingle_sets(_grouped(texts, ids, few)), "grouped-sets")

    labels = stored(components(_linked(_pivot_pairs(members), sketched, sets)), "components")
    rest = _linked(_prefix_pairs(sets, sketched, labels), sketched, sets)
    if rest.limit(1).count():
        labels = stored(components(rest.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))), "components")

    # classes and labels are written tables, so a hot class is split over tasks here
    joined = slim.join(_renamed(classes, class_id="doc_id", n="n", d1="d1", d2="d2").hint("merge"), ["n", "d1", "d2"], "left")
    joined = joined.join(_renamed(labels, class_id="node", component="component").hint("merge"), "class_id", "left")
    component = F.coalesce("component", "class_id", "doc_id")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept: of each group the one with the smallest id, same columns."""
    name = "_near_id"
    while name in docs.columns:
        name += "_"
    dropped = stored(cluster(docs, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(name)), "dropped-ids")
    dropped = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped.hint("merge")
    return docs.join(dropped, docs[id_col] == dropped[name], "left_anti")
