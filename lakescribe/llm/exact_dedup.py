"""Exact dedup by two Bloom passes (operator 9).

Texts are equal when they agree after all white space is deleted. The text of each row is read and
hashed once, into a slim table (id, key, length, 64-bit hash of the key) that all else works on.

Pass one marks two filter positions per row. Each task keeps two bitmaps, of positions marked once and
of those marked twice or more, and only pieces of these bitmaps are shuffled and merged, no row and no
key. A position marked once cannot belong to a repeated text. Pass two probes each row: if either
position was marked once only its text is unique and it passes straight through; the others
(repeated ones and false alarms) are shuffled by key and settled exactly, without their texts.

The filter has ``BITS_PER_ROW`` bits a row at any size, so that some 2 % of the unique rows are false alarms.
It is cut into blocks by hash, of ``BLOCK_BITS`` bits (a broadcast of 32 MB) at most. Where a table needs several
(beyond some 17 million rows), its rows are written into a folder per block, from where each block is read for
its own two passes: what is read does not depend on the number of blocks, and one bitmap is held at a time.

``dedup`` drops rows by such a filter of the ids that go; only rows that it hits are hashed again and compared.

Of equal texts the row with most code points stays, then the smallest id. Defined results: null text
is the empty text; an empty table gives no rows; a null id loses to any other; rows with the same id
count as that many copies and share their fate; extra columns pass through ``dedup``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

SPACE = "".join(map(chr, [0x20, *range(0x09, 0x0E)]))
BITS_PER_ROW = 16
BLOCK_BITS = 1 << 28
PIECE_WORDS = 1 << 13  # of a bitmap in one shuffled row


def text_key(text: Column) -> Column:
    """Hex SHA-256 of the text without white space."""
    bare = reduce(lambda t, space: F.replace(t, F.lit(space), F.lit("")), SPACE, F.coalesce(text, F.lit("")))
    return F.sha2(bare, 256)


def slim_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, chars, hash) of every row, written once."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.coalesce(F.length(text_col), F.lit(0)).alias("chars"))
    return stored(rows.withColumn("hash", F.xxhash64("key")), "slim")


def filter_shape(rows: int) -> tuple[int, int]:
    """(number of blocks, bits of each) of a filter for so many rows; both are powers of two."""
    bits = 1 << max(10, (rows * BITS_PER_ROW - 1).bit_length())
    return max(1, bits // BLOCK_BITS), min(bits, BLOCK_BITS)


def block_of(hashed: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(hashed, 48).bitwiseAND(F.lit(blocks - 1)) if blocks > 1 else F.lit(0).cast("long")


def _positions(hashed: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), hashed), F.lit(bits)) for i in (1, 2)]


def _mark(once: np.ndarray, twice: np.ndarray, positions: np.ndarray) -> None:
    """Marks each of ``positions`` in the bitmaps."""
    positions, times = np.unique(positions, return_counts=True)
    for rows, again in ((times > 0, False), (times > 1, True)):
        at = positions[rows]
        words, first = np.unique(at >> 6, return_index=True)
        if len(words):
            masks = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
            twice[words] |= masks if again else once[words] & masks
            once[words] |= masks


def bitmap(hits: DataFrame, bits: int, least: int) -> np.ndarray:
    """Words of ``bits`` bits that are set where ``least`` (1 or 2) or more positions of the rows of ``hits`` (hash) fall."""
    width = min(PIECE_WORDS, bits // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, empty = np.zeros(bits // 64, np.uint64), np.zeros(bits // 64, np.uint64), True
        for batch in batches:
            _mark(once, twice, np.concatenate([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            empty = empty and not len(batch)
        for k in range(0 if empty else len(once) // width):
            a, b = (x[k * width : (k + 1) * width] for x in (once, twice))
            if a.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["piece", "once", "twice"])

    def merged(pieces: pa.Table) -> pa.Table:
        once, twice = np.zeros(width, np.uint64), np.zeros(width, np.uint64)
        for a, b in zip(pieces["once"], pieces["twice"], strict=True):
            a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
            twice |= b | once & a
            once |= a
        return pa.table({"piece": pieces["piece"].slice(0, 1), "words": pa.array([(once if least == 1 else twice).tobytes()])})

    positions = [p.alias(f"p{i}") for i, p in enumerate(_positions(F.col("hash"), bits))]
    pieces = hits.select(*positions).mapInArrow(run, "piece int, once binary, twice binary")
    words = pieces.groupBy("piece").applyInArrow(merged, "piece int, words binary").toArrow()
    out = np.zeros((bits // 64 // width, width), np.uint64)
    for piece, own in zip(words["piece"], words["words"], strict=True):
        out[piece.as_py()] = np.frombuffer(own.as_py(), np.uint64)
    return out.reshape(-1)


def hit_by(hashed: Column, bits: int, words: np.ndarray, spark) -> Column:
    """Are both positions of the hash set? The bitmap is a broadcast of bits / 8 bytes."""
    shared = spark.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def both(a: pa.Array, b: pa.Array) -> pa.Array:
        known = shared.value
        found = [(known[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) for p in (a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False))]
        return pa.array((found[0] & found[1]).astype(bool))

    return both(*_positions(hashed, bits))


def probed(rows: DataFrame, hits: DataFrame, count: int, least: int) -> DataFrame:
    """``rows`` (hash and others) with a column maybe: may ``least`` or more of the ``count`` rows of ``hits`` have the row's hash?"""
    blocks, bits = filter_shape(count)
    if blocks == 1:
        return rows.withColumn("maybe", hit_by(F.col("hash"), bits, bitmap(hits, bits, least), rows.sparkSession))
    own = block_of(F.col("hash"), blocks).cast("int")
    marked = stored(hits.select("hash", own.alias("block")), "hits", by="block")
    split = stored(rows.withColumn("block", own), "rows", by="block")
    parts = []
    for b in range(blocks):
        words = bitmap(marked.filter(F.col("block") == b), bits, least)
        mine = split.filter(F.col("block") == b).drop("block")
        parts.append(stored(mine.withColumn("maybe", hit_by(F.col("hash"), bits, words, rows.sparkSession)), "probed"))
    return reduce(DataFrame.unionByName, parts)


def _settled(slim: DataFrame) -> DataFrame:
    """``slim`` with keep (id of the row that stays) and size (rows of equal text)."""
    flagged = stored(probed(slim, slim, slim.count(), 2), "flagged")
    once = flagged.filter("not maybe").withColumns({"keep": F.col("id"), "size": F.lit(1).cast("long")})
    maybe = flagged.filter("maybe")
    best = F.max(F.struct(F.col("chars"), F.col("id").isNotNull(), -F.col("id")))
    groups = maybe.groupBy(F.col("key").alias("_group")).agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
    # written, so that adaptive execution can split the rows of a hot key in the join
    groups = stored(groups.select("_group", (-F.col("best.col3")).alias("keep"), "size"), "groups")
    return once.unionByName(maybe.join(groups.hint("merge"), F.col("key") == F.col("_group")).drop("_group"))


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256."""
    kept = F.col("id").eqNullSafe(F.col("keep"))
    return _settled(slim_rows(docs, id_col, text_col)).select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.col("key").alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the same columns; rows whose id the filter misses do not shuffle."""
    settled = _settled(slim_rows(docs, id_col, text_col)).filter(~F.col("id").eqNullSafe(F.col("keep")))
    gone = stored(settled.select("id", "key", F.xxhash64("id").alias("hash")), "dropped-copies")
    held = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("hash"))
    held = probed(held, gone, gone.count(), 1)
    stay = held.filter("not maybe").select("row.*")
    left = held.filter("maybe").select("row", "id", text_key(F.col("text")).alias("key")).alias("a")
    pairs = gone.select("id", "key").distinct().hint("merge").alias("b")
    same = F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.key") == F.col("b.key"))
    return stay.unionAll(left.join(pairs, same, "left_anti").select("row.*"))
