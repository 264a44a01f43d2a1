"""Toxicity by a factorization machine over hashed terms (operator 6).

A text's terms are its words and the words' beginnings (for inflected and compounded forms), hashed
into ``1 << TERM_BITS`` slots. The machine scores w0 + sum of w_j + sum over pairs of <v_j, v_k>, so a
pair such as an insult and a group mention can count for more, or less, than both alone. It is
trained with numpy on the driver on a bounded sample of labelled rows: at most about ``TRAIN_ROWS``,
picked by a hash of the id, each with ``DOC_TERMS`` of its distinct terms at most, picked by a hash too, so
that what the driver holds is bounded in bytes. (Scoring uses all terms.) Of the slots only the ``MAX_TERMS`` that tell the classes apart best
(chi-squared) get parameters, so the broadcast model is a few megabytes at any input size. Terms come
from the text alone: labels, language, source and id are no inputs of a score.

Defined results: null is the empty text, scored by the bias; unlabelled rows, null labels and rows
outside the training part teach nothing; without two classes the score is the smoothed base rate;
an empty table gives no rows; repeated rows are scored alike; extra columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import Chunk, chunks, mix64

TERM_BITS = 20
#: Word beginnings of so many bytes are terms, for words that are longer.
PREFIXES = (4, 5)
TRAIN_ROWS, DOC_TERMS, MAX_TERMS, MIN_ROWS = 16_000, 4000, 8192, 3
RANK, EPOCHS, BATCH, RATE, DECAY = 4, 12, 256, 0.1, 1e-4
THRESHOLD = 0.3

_BREAK = np.zeros(256, bool)
_BREAK[[b for b in range(128) if not chr(b).isalnum()]] = True


def _term_slots(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of every term of a chunk, with repeats."""
    latin = (chunk.data[1:] >= 0x80) & (chunk.data[1:] <= 0x9E) & (chunk.data[1:] != 0x97) & (chunk.data[:-1] == 0xC3)
    chunk.data[1:][latin] += 0x20
    starts, ends, first = chunk.bounds(_BREAK[chunk.data])
    text = np.repeat(np.arange(len(chunk)), np.diff(first))
    texts, hashes = [text], [chunk.hashes(starts, ends)]
    for k in PREFIXES:
        longer = ends - starts > k
        texts.append(text[longer])
        hashes.append(mix64(chunk.hashes(starts[longer], starts[longer] + k) + np.uint64(k)))
    return np.concatenate(texts), (np.concatenate(hashes) >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def _distinct(text: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(text << 32 | slot)
    return pair >> 32, pair & 0xFFFFFFFF


def _fewer(text: np.ndarray, slot: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (text, slot) pairs with ``most`` slots of a text at most: those of least hash."""
    keep = np.ones(len(text), bool)
    for i in np.flatnonzero(np.bincount(text) > most):
        a, b = np.searchsorted(text, [i, i + 1])
        keep[a:b] = False
        keep[a + np.argsort(mix64(slot[a:b].astype(np.uint64)), kind="stable")[:most]] = True
    return text[keep], slot[keep]


def _counted(slot: np.ndarray) -> np.ndarray:
    """How often each slot occurs, counted piece by piece to save memory."""
    out = np.zeros(1 << TERM_BITS)
    for a in range(0, len(slot), 1 << 20):
        out += np.bincount(slot[a : a + (1 << 20)], minlength=1 << TERM_BITS)
    return out


@dataclass
class Machine:
    """index: slot to parameter row, -1 where none."""

    index: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, text: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Scores before the logistic, of ``n`` texts with sorted (text, parameter row) pairs."""
        linear = np.bincount(text, self.weights[row], n)
        pairs = np.zeros(n)
        for k in range(self.factors.shape[1]):
            v = self.factors[row, k]
            pairs += np.bincount(text, v, n) ** 2 - np.bincount(text, v * v, n)
        return self.bias + linear + pairs / 2

    def score(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for chunk in chunks(column, lower=True):
            text, slot = _term_slots(chunk)
            row = self.index[slot]
            text, row = _distinct(text[row >= 0], row[row >= 0])
            out.append(1 / (1 + np.exp(-np.clip(self.raw(text, row, len(chunk)), -40, 40))))
        return np.concatenate(out)


def labelled_terms(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(slots, label) of about ``rows`` labelled documents at most; several labels of an id count as their maximum."""
    known = labels.filter("toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_label"))
    part = min(1.0, rows / max(1, known.count()))
    lot = F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    taken = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(known.filter(lot < part).hint("merge"), F.col("_doc") == F.col("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1), lower=True):
                text, slot = _fewer(*_distinct(*_term_slots(chunk)), DOC_TERMS)
                cuts = np.searchsorted(text, np.arange(len(chunk) + 1)).astype(np.int32)
                slots = pa.ListArray.from_arrays(pa.array(cuts), pa.array(slot.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), slots, batch.column(2).slice(chunk.first, len(chunk))], names=["doc", "slots", "label"])

    return taken.selectExpr("cast(_doc as long) as doc", "_text", "_label").mapInArrow(run, "doc long, slots array<int>, label int")


def fit(terms: pa.Table, seed: int = 7) -> Machine:
    """A machine for (doc, slots, label) rows; their order does not matter."""
    terms = terms.sort_by("doc")
    labels = terms["label"].to_numpy().astype(np.float64)
    index = np.full(1 << TERM_BITS, -1, np.int32)
    prior = (labels.sum() + 0.5) / (len(labels) + 1)
    machine = Machine(index, float(np.log(prior / (1 - prior))), np.zeros(1), np.zeros((1, RANK)))
    positive = int(labels.sum())
    if positive in (0, len(labels)):
        return machine
    slots = terms["slots"].combine_chunks()
    slots = slots.chunk(0) if isinstance(slots, pa.ChunkedArray) else slots
    counts = np.diff(slots.offsets.to_numpy())
    slot, text = slots.flatten().to_numpy(), np.repeat(np.arange(len(labels), dtype=np.int32), counts)
    total = _counted(slot)
    hits = _counted(slot[(labels > 0)[text]])
    share = positive / len(labels)
    expected = total * share
    chi = np.where(total >= min(MIN_ROWS, positive), (hits - expected) ** 2 / np.maximum(expected * (1 - share), 1e-9), 0)
    best = np.argsort(-chi, kind="stable")[:MAX_TERMS]
    best = best[chi[best] > 4.0]
    index[best] = np.arange(len(best))
    row = index[slot]
    text, row = text[row >= 0], row[row >= 0]
    rng = np.random.default_rng(seed)
    machine.weights = np.zeros(max(1, len(best)))
    machine.factors = rng.normal(0, 0.01, (max(1, len(best)), RANK))
    first = np.searchsorted(text, np.arange(len(labels) + 1))
    square = [np.full_like(machine.weights, 1e-6), np.full_like(machine.factors, 1e-6), 1e-6]
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), BATCH):
            _step(machine, square, [row[first[d] : first[d + 1]] for d in order[a : a + BATCH]], labels[order[a : a + BATCH]])
    return machine


def _step(machine: Machine, square: list, rows: list[np.ndarray], labels: np.ndarray) -> None:
    """One AdaGrad step of the logistic loss."""
    n = len(rows)
    text = np.repeat(np.arange(n), [len(r) for r in rows])
    row = np.concatenate(rows)
    v = machine.factors[row]
    sums = np.stack([np.bincount(text, v[:, k], n) for k in range(RANK)], 1)
    raw = machine.bias + np.bincount(text, machine.weights[row], n) + ((sums**2).sum(1) - np.bincount(text, (v * v).sum(1), n)) / 2
    error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels) / np.sqrt(n)
    used, at = np.unique(row, return_inverse=True)
    grad = np.bincount(at, error[text]) + DECAY * machine.weights[used] if len(used) else np.zeros(0)
    square[0][used] += grad**2
    machine.weights[used] -= RATE * grad / np.sqrt(square[0][used] + 1e-3)
    pull = error[text, None] * (sums[text] - v)
    for k in range(RANK):
        grad = (np.bincount(at, pull[:, k]) + DECAY * machine.factors[used, k]) if len(used) else np.zeros(0)
        square[1][used, k] += grad**2
        machine.factors[used, k] -= RATE / 4 * grad / np.sqrt(square[1][used, k] + 1e-3)
    grad = error.sum()
    square[2] += grad**2
    machine.bias -= RATE * grad / np.sqrt(square[2] + 1e-3)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    return fit(labelled_terms(docs, labels, id_col, text_col).toArrow())


def with_score(docs: DataFrame, machine: Machine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; only the text goes through Python."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(text))

    return docs.withColumn(score_col, score(F.col(text_col)))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, same columns."""
    machine = train(docs, labels, id_col, text_col)
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    kept = with_score(docs, machine, text_col, name).filter(F.col(name) < threshold)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
