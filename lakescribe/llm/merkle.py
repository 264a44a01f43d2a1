"""Merkle manifest of a dataset as a postorder append log (operator 12).

Every row is a leaf, the hash of its fields. Per source the leaves ascend by id and every 16 consecutive
nodes (the last run may be shorter) become their hash, until one is left, the subroot; subroots by
source become the root in the same way.

Builders work on aligned blocks of 16 ** BLOCK_LEVELS items and append a node to the log as soon as its
children are complete. So a node has a position that needs no lookup: by subtree sizes, the nodes that are
complete with the last leaf e that it covers. ``position(e, level) = sum of e // 16 ** k over k >= 0, plus level``.
Within a block the log is one stretch, and a proof addresses its siblings there by the same formula. The nodes
above the blocks are built in further rounds, with the blocks' tops as items; proofs come from the top round
downwards, each block getting the part above it with its rows.

Work is spread over blocks, so a source of any size is many tasks; a task holds one block of 256 items.

Defined results: a null field counts as "-"; a null source is a source of its own and comes first; a
null id comes first; rows with the same id are ordered by their hash, and equal rows are leaves of their
own; an empty table has no nodes and no rows; extra columns are not read. Nodes and proofs hold no text, so
memory does not depend on the texts' length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .ranks import ranked
from .scratch import stored

FAN, BLOCK_LEVELS = 16, 2
BLOCK = FAN**BLOCK_LEVELS
#: Characters of a digest.
WIDTH = 64
#: Rows that a task hands on at once.
_ROWS = 2000


def leaf_hash(*fields: Column) -> Column:
    """Hex SHA-256 of the fields, each as its UTF-8 byte count, a colon and its value, "-" if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def position(last: int, level: int) -> int:
    """Place in the log, from 0, of the node of ``level`` whose last leaf is ``last``."""
    total = level
    while last:
        total, last = total + last, last // FAN
    return total


def _completed(hashes: list[str], first: bool) -> Iterator[tuple[int, int, str]]:
    """(level, item it ends with, hash) of a block's nodes in order of completion; only a ``first`` block that is not full ends below BLOCK_LEVELS."""
    height = next(h for h in range(BLOCK_LEVELS + 1) if FAN**h >= len(hashes)) if first else BLOCK_LEVELS
    runs: list[list[str]] = [[] for _ in range(height + 1)]

    def close(level: int, at: int, value: str) -> Iterator[tuple[int, int, str]]:
        yield level, at, value
        runs[level].append(value)
        if level < height and len(runs[level]) == FAN:
            yield from up(level, at)

    def up(level: int, at: int) -> Iterator[tuple[int, int, str]]:
        run, runs[level] = runs[level], []
        yield from close(level + 1, at, digest("".join(run)))

    for at, value in enumerate(hashes):
        yield from close(0, at, value)
    for level in range(height):
        if runs[level]:
            yield from up(level, len(hashes) - 1)


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of consecutive rows that agree in their first ``width`` columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:width] != key:
                if held:
                    yield key, held
                key, held = row[:width], []
            held.append(row[width:])
    if held:
        yield key, held


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= _ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


def _schema(shape: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(shape)


def _fields(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields])


def _build(items: DataFrame) -> list[DataFrame]:
    """The rounds over ``items`` (group, rank, hash, id, altered), each a written table of nodes.

    A node has group, block, position, level, last (the last leaf it covers), hash, top (is it its block's last?), and an item
    its id and altered. All tops go on to the next round; a group with one top is one item there and gets no new node.
    """
    kinds = {f.name: f.dataType for f in items.schema}
    shape = _fields(("group", StringType()), ("block", LongType()), ("position", LongType()), ("level", IntegerType()), ("last", LongType()), ("hash", StringType()), ("top", BooleanType()), ("id", kinds["id"]), ("altered", StringType()))
    arrow = _schema(shape)

    def builder(base: int) -> Callable:
        def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for (group, block), rows in _grouped(batches, 2):
                made = list(_completed([r[1] for r in rows], block == 0))
                for level, at, value in made:
                    last, _, own, altered = rows[at]
                    item = (own, altered) if level == 0 else (None, None)
                    yield group, block, position(last, base + level), base + level, last, value, level == made[-1][0], *item

        return lambda batches: _batches(nodes(batches), arrow)

    rounds, level = [], 0
    current = items.select("group", F.floor(F.col("rank") / BLOCK).alias("block"), F.col("rank").alias("last"), "hash", "id", "altered")
    while True:
        dealt = current.repartition("group", "block").sortWithinPartitions("group", "block", "last")
        rounds.append(stored(dealt.mapInArrow(builder(level), shape), "nodes"))
        tops = rounds[-1].filter("top")
        if not tops.filter("block > 0").limit(1).count():
            return rounds
        level += BLOCK_LEVELS
        current = tops.select("group", F.floor(F.col("block") / BLOCK).alias("block"), "last", "hash", F.lit(None).cast(kinds["id"]).alias("id"), F.lit(None).cast("string").alias("altered"))


def _extracted(rounds: list[DataFrame], above: DataFrame | None, full: bool) -> DataFrame:
    """The items of the first round with their proofs.

    ``above`` has (group, places, runs, subroot): the part above each group. A proof is, level by level, the place of
    the own node in its run and the run's digests in one string. ``full``: give places and runs; else their
    digest without the own nodes (proof_sha256) and the root that the altered item, or the item, folds to (folded_root).
    """
    kinds = {f.name: f.dataType for f in rounds[0].schema}
    path = (("places", ArrayType(IntegerType())), ("runs", ArrayType(StringType())))
    ends = (("proof_sha256", StringType()), ("folded_root", StringType()))
    lower = _fields(("group", StringType()), ("block", LongType()), *path, ("subroot", StringType()))
    last = _fields(("group", StringType()), ("id", kinds["id"]), ("hash", StringType()), ("subroot", StringType()), *(path if full else ends))

    def extractor(base: int) -> Callable:
        final = base == 0
        arrow = _schema(last if final else lower)

        def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for (group, block), rows in _grouped(batches, 2):
                over, runs_over, subroot = [], [], None
                if rows[0][0] < 0:
                    over, runs_over, subroot = rows[0][-3:]
                    rows = rows[1:]
                items = [r for r in rows if r[1] == base]
                stretch, n = [r[2] for r in rows], len(items)
                levels = []
                for level in range(rows[-1][1] - base):
                    span = FAN**level
                    row = [stretch[position(min((j + 1) * span, n) - 1, level)] for j in range(-(-n // span))]
                    levels.append(["".join(row[s : s + FAN]) for s in range(0, len(row), FAN)])
                for i, item in enumerate(items):
                    places = [i // FAN**level % FAN for level in range(len(levels))] + over
                    runs = [levels[level][i // FAN ** (level + 1)] for level in range(len(levels))] + runs_over
                    if not final:
                        yield group, block * BLOCK + i, places, runs, subroot
                    elif full:
                        yield group, item[3], item[2], subroot, places, runs
                    else:
                        folded, siblings = item[2] if item[4] is None else item[4], []
                        for place, run in zip(places, runs, strict=True):
                            before, after = run[: place * WIDTH], run[(place + 1) * WIDTH :]
                            siblings += before, after
                            folded = digest(before + folded + after)
                        yield group, item[3], item[2], subroot, digest("".join(siblings)), folded

        return lambda batches: _batches(paths(batches), arrow)

    none = [F.lit(None).cast(kind).alias(name) for name, kind in (*path, ("subroot", StringType()))]
    if above is not None:
        above = above.withColumn("block", F.lit(0).cast("long"))
    for at in range(len(rounds) - 1, -1, -1):
        rows = rounds[at].select("group", "block", "position", "level", "hash", "id", "altered", *none)
        if above is not None:
            heads = above.select("group", "block", F.lit(-1).cast("long").alias("position"), F.lit(-1).alias("level"), *[F.lit(None).cast(kinds[c]).alias(c) for c in ("hash", "id", "altered")], "places", "runs", "subroot")
            rows = rows.unionByName(heads)
        dealt = rows.repartition("group", "block").sortWithinPartitions("group", "block", "position")
        above = dealt.mapInArrow(extractor(at * BLOCK_LEVELS), lower if at else last)
        if at:
            above = stored(above, "paths")
    return above


class Manifest(NamedTuple):
    """Rounds of the trees of the sources and of the tree over them, and the root (None for an empty table)."""

    sources: list[DataFrame]
    top: list[DataFrame]
    root: str | None

    @property
    def log(self) -> DataFrame:
        """(source, position, level, hash) of every node of the sources' trees; position counts within the source."""
        parts = [nodes.filter(F.col("level") > at * BLOCK_LEVELS if at else F.lit(True)) for at, nodes in enumerate(self.sources)]
        return reduce(DataFrame.unionByName, parts).select(F.col("group").alias("source"), "position", "level", "hash")


def build(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source", altered: Column | None = None) -> Manifest:
    """The manifest of ``docs``. ``altered``: another hash to fold for a row, NULL for its own."""
    other = F.lit(None).cast("string") if altered is None else altered
    leaves = stored(docs.select(F.col(source_col).cast("string").alias("group"), F.col(id_col).alias("id"), leaf_hash(*[F.col(c) for c in fields]).alias("hash"), other.alias("altered")), "leaves")
    sources = _build(ranked(leaves, "group", ["id", "hash"]))
    subroots = sources[-1].filter("top").select(F.lit(None).cast("string").alias("group"), F.col("group").alias("id"), "hash", F.lit(None).cast("string").alias("altered"))
    top = _build(ranked(stored(subroots, "subroots"), "group", ["id"]))
    root = top[-1].filter("top").select("hash").first()
    return Manifest(sources, top, root and root[0])


def proofs(manifest: Manifest, full: bool = True) -> DataFrame:
    """Per row: id, leaf, subroot, root, and either its whole proof (places, runs) or proof_sha256 and folded_root."""
    above = _extracted(manifest.top, None, True).select(F.col("id").alias("group"), "places", "runs", F.col("hash").alias("subroot"))
    found = _extracted(manifest.sources, stored(above, "paths"), full)
    return found.select("id", F.col("hash").alias("leaf"), "subroot", F.lit(manifest.root).cast("string").alias("root"), *(("places", "runs") if full else ("proof_sha256", "folded_root")))
