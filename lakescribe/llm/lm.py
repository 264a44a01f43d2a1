"""LM scoring with a log-bilinear neural model trained by noise-contrastive estimation (operator 10).

Tokens are the words of a text, A-Z lower-cased, and one end. The ``OWN`` most frequent tokens are
classes of their own, all other words share ``TAILS`` classes by their last bytes. The model predicts
the class of a token from the classes of the two before it: r = w1 * R[c1] + w2 * R[c2],
score(c) = r . Q[c] + b[c], normalised by a softmax over all classes. Inside a shared class, unseen
words together have the probability u = (words seen once + 0.5) / (class total + 1), a seen word has
(1 - u) * count / class total. So the probabilities of all tokens and "unseen" sum to one in every
context.

What Spark gathers from all training texts: the count of every word, and of every class trigram.
The latter table has (OWN + TAILS + 1)**3 rows at most at any input size; it is dealt into parts of some
``SHARD_ROWS`` rows (``SHARDS`` parts at least, so some 70 at most). NCE runs on all parts at once, draws
examples by their counts, and after each of ``ROUNDS`` rounds the parts' parameters are averaged.

Scoring: the ``FREQUENT`` most frequent words' counts are a broadcast table of that bounded size; the
other words of each text are joined with the full count table by a shuffle. No key of that join
can hold more than 1 / FREQUENT of all training words.

Defined results: null is the empty text, which has the end token only; an empty training part gives
zero counts; an empty table gives no rows; rows with the same id are scored one by one; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .tokens import chunks

OWN, TAILS, SUFFIX_BYTES = 400, 112, 3
CLASSES = OWN + TAILS
START = CLASSES  # context only
FREQUENT = 1 << 17
DIM, NOISE, BATCH, STEPS, ROUNDS, RATE = 32, 128, 2048, 400, 3, 0.15
SHARDS, SHARD_ROWS = 6, 2_000_000
#: Counts are emitted once so many tokens have been gathered.
GATHER = 1 << 20
#: The end token's key.
END = np.uint64(0x45AD45AD45AD45AD)


def _sequence(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token keys, tail classes, each text's first token) with an end after every text."""
    starts, ends, first = chunk.words()
    text = np.repeat(np.arange(len(chunk)), np.diff(first))
    at = np.arange(len(starts)) + text
    total = len(starts) + len(chunk)
    keys, tails = np.full(total, END, np.uint64), np.zeros(total, np.int32)
    keys[at] = chunk.hashes(starts, ends)
    tails[at] = OWN + (chunk.hashes(np.maximum(starts, ends - SUFFIX_BYTES), ends) % np.uint64(TAILS)).astype(np.int32)
    return keys, tails, first + np.arange(len(chunk) + 1)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    distinct, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    return distinct, n if counts is None else np.bincount(at, np.concatenate(counts)).astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(key, tail, n) of every token of a table with one column of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            all_keys, all_tails = np.concatenate(held[0]), np.concatenate(held[1])
            keys, where, n = np.unique(all_keys, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(all_tails[where]), pa.array(n.astype(np.int64))], names=["key", "tail", "n"])

        held, size = ([], []), 0
        for batch in batches:
            for chunk in chunks(batch.column(0), lower=True):
                keys, tails, _ = _sequence(chunk)
                held[0].append(keys)
                held[1].append(tails)
                size += len(keys)
                if size >= GATHER:
                    yield emit()
                    held, size = ([], []), 0
        if size:
            yield emit()

    parts = texts.mapInArrow(run, "key long, tail int, n long")
    return parts.groupBy("key").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Tables:
    """Bounded tables that every task holds: frequent words with their counts, classes, class totals."""

    keys: np.ndarray  # frequent keys, sorted
    counts: np.ndarray
    own: np.ndarray  # class of a frequent key, -1 where it shares a tail class
    unseen: np.ndarray  # by class: log10 of u; 0 for own classes
    scale: np.ndarray  # by class: log10 of (1 - u) / class total; 0 for own classes
    train_tokens: int
    vocabulary: int

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys among the frequent ones, -1 where they are none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def classes(self, keys: np.ndarray, tails: np.ndarray, place: np.ndarray) -> np.ndarray:
        own = np.where(place >= 0, self.own[place], -1) if len(self.own) else np.full(len(keys), -1)
        return np.where(keys == END, 0, np.where(own >= 0, own, tails))


def tables(vocabulary: DataFrame) -> Tables:
    """From the written count table: its FREQUENT most frequent words, and totals by tail class."""
    top = vocabulary.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    keys, counts = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    own = np.full(len(keys), -1, np.int32)
    words = np.flatnonzero(keys != END)[: OWN - 1]  # class 0 is the end
    own[words] = 1 + np.arange(len(words))
    own[keys == END] = 0
    totals = vocabulary.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), F.count_if(F.col("n") == 1).alias("once")).collect()
    n, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in totals:
        if r.tail >= OWN:
            n[r.tail], once[r.tail] = r.n, r.once
    tail_of = top["tail"].to_numpy()
    np.subtract.at(n, tail_of[words], counts[words])
    np.subtract.at(once, tail_of[words], counts[words] == 1)
    u = (once + 0.5) / (n + 1)
    u[n == 0] = 1
    unseen, scale = np.log10(u), np.log10(np.where(u < 1, (1 - u) / np.maximum(n, 1), 1))
    unseen[:OWN] = scale[:OWN] = 0
    order = np.argsort(keys)
    return Tables(keys[order], counts[order], own[order], unseen, scale, int(sum(r.n for r in totals)), int(sum(r.words for r in totals)))


def _contexts(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Class of the token two before times (CLASSES + 1), plus that of the one before; START before the text."""
    one = np.concatenate([[START], classes[:-1]])
    one[first[:-1]] = START
    two = np.concatenate([[START], one[:-1]])
    two[first[:-1]] = START
    return two.astype(np.int64) * (CLASSES + 1) + one


def trigram_counts(texts: DataFrame, shared) -> DataFrame:
    """(gram, n): counts of context * CLASSES + class over a table with one column of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = shared.value, [], 0
        for batch in batches:
            for chunk in chunks(batch.column(0), lower=True):
                keys, tails, first = _sequence(chunk)
                classes = known.classes(keys, tails, known.look_up(keys))
                held.append(_contexts(classes, first) * CLASSES + classes)
                size += len(keys)
                if size >= GATHER:
                    grams, n = _summed(held)
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "n"])
                    held, size = [], 0
        if size:
            grams, n = _summed(held)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _scatter(out: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """out[index] += rows, summing over repeated indices."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    lead = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
    out[index[lead]] += np.add.reduceat(rows[order], lead, axis=0)


class LogBilinear:
    """Parameters of the model as one vector: R, Q, b, w1, w2."""

    def __init__(self, vector: np.ndarray):
        self.vector = vector
        cuts = np.cumsum([(CLASSES + 1) * DIM, CLASSES * DIM, CLASSES, DIM, DIM])
        self.context, self.target, self.bias, self.near, self.far = np.split(vector, cuts[:-1])
        self.context, self.target = self.context.reshape(-1, DIM), self.target.reshape(-1, DIM)

    @classmethod
    def fresh(cls, unigram: np.ndarray) -> LogBilinear:
        rng = np.random.default_rng(11)
        return cls(
            np.concatenate([rng.normal(0, 0.1, (2 * CLASSES + 1) * DIM), np.log(unigram), np.full(DIM, 1.0), np.full(DIM, 0.5)]).astype(np.float32)
        )

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        return self.far * self.context[contexts // (CLASSES + 1)] + self.near * self.context[contexts % (CLASSES + 1)]

    def log_norm(self, contexts: np.ndarray) -> np.ndarray:
        """Natural log of the sum over all classes, by matrix products of blocks of contexts."""
        out = np.empty(len(contexts), np.float32)
        for a in range(0, len(contexts), 2048):
            scores = self.predicted(contexts[a : a + 2048]) @ self.target.T + self.bias
            top = scores.max(1)
            out[a : a + 2048] = top + np.log(np.exp(scores - top[:, None]).sum(1))
        return out

    def train(self, grams: np.ndarray, counts: np.ndarray, unigram: np.ndarray, steps: int, seed: int) -> None:
        """AdaGrad on the NCE loss; examples are drawn by count, noise by the classes' unigram shares."""
        rng = np.random.default_rng(seed)
        upto, noise_upto = np.cumsum(counts), np.cumsum(unigram)
        square = LogBilinear(np.full_like(self.vector, 1e-4))
        grad = LogBilinear(np.zeros_like(self.vector))
        log_noise = np.log(NOISE * unigram).astype(np.float32)
        for _ in range(steps):
            gram = grams[np.searchsorted(upto, rng.integers(0, upto[-1], BATCH), side="right")]
            noise = np.minimum(np.searchsorted(noise_upto, rng.random(NOISE) * noise_upto[-1], side="right"), CLASSES - 1)
            context, c = gram // CLASSES, gram % CLASSES
            two, one = context // (CLASSES + 1), context % (CLASSES + 1)
            r = self.predicted(context)
            right = 1 / (1 + np.exp(log_noise[c] - (r * self.target[c]).sum(1) - self.bias[c])) - 1
            wrong = 1 / (1 + np.exp(log_noise[noise] - r @ self.target[noise].T - self.bias[noise]))
            right, wrong = right / BATCH, wrong / BATCH
            grad.vector[:] = 0
            _scatter(grad.target, c, right[:, None] * r)
            _scatter(grad.target, noise, wrong.T @ r)
            _scatter(grad.bias, c, right)
            _scatter(grad.bias, noise, wrong.sum(0))
            pull = right[:, None] * self.target[c] + wrong @ self.target[noise]
            _scatter(grad.context, two, self.far * pull)
            _scatter(grad.context, one, self.near * pull)
            grad.far += (self.context[two] * pull).sum(0)
            grad.near += (self.context[one] * pull).sum(0)
            square.vector += grad.vector**2
            self.vector -= RATE * grad.vector / np.sqrt(square.vector + 1e-8)


def fit(grams: DataFrame) -> LogBilinear:
    """A model from a written (gram, n) table."""
    unigram = np.full(CLASSES, 0.5)
    rows = 0
    for r in grams.groupBy((F.col("gram") % CLASSES).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect():
        unigram[r.c] += r.n
        rows += r.rows
    unigram /= unigram.sum()
    model = LogBilinear.fresh(unigram)
    dealt = grams.repartition(max(SHARDS, -(-rows // SHARD_ROWS)))
    for at in range(ROUNDS):
        vector = model.vector

        def run(batches: Iterator[pa.RecordBatch], vector: np.ndarray = vector, at: int = at) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(batches, schema=pa.schema([("gram", pa.int64()), ("n", pa.int64())])).sort_by("gram")
            if len(rows):
                part = LogBilinear(vector.copy())
                counts = rows["n"].to_numpy()
                part.train(rows["gram"].to_numpy(), counts, unigram, STEPS, int(rows["gram"][0].as_py()) + at)
                yield pa.RecordBatch.from_arrays([pa.array([part.vector.tobytes()], pa.binary()), pa.array([int(counts.sum())])], names=["vector", "n"])

        # a row of some 130 KB for each part
        parts = [(np.frombuffer(bytes(r.vector), np.float32), r.n) for r in dealt.mapInArrow(run, "vector binary, n long").collect()]
        if parts:
            model = LogBilinear(np.average([v for v, _ in parts], axis=0, weights=[n for _, n in parts]).astype(np.float32))
    return model


PARTS = "row long, doc_id long, n_tokens long, known long, base double, score double, keys array<long>, counts array<int>, fresh array<int>"


def _scored(docs: DataFrame, shared) -> DataFrame:
    """Everything about a text that bounded tables can tell, and its other words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        log_counts, plain = np.log10(known.counts + 0.5), np.log10(np.maximum(known.counts, 1))
        norms = np.full((CLASSES + 1) ** 2, np.nan, np.float32)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for chunk in chunks(batch.column(1), lower=True):
                keys, tails, first = _sequence(chunk)
                place = known.look_up(keys)
                classes = known.classes(keys, tails, place)
                contexts = _contexts(classes, first)
                new = np.unique(contexts)
                new = new[np.isnan(norms[new])]
                norms[new] = model.log_norm(new)
                gram, at = np.unique(contexts * CLASSES + classes, return_inverse=True)
                c, ctx = gram % CLASSES, gram // CLASSES
                value = ((model.predicted(ctx) * model.target[c]).sum(1) + model.bias[c] - norms[ctx]).astype(np.float64)[at] / np.log(10)
                logs = np.where(place >= 0, log_counts[place], np.log10(0.5)) if len(log_counts) else np.full(len(keys), np.log10(0.5))
                seen = (plain[place] if len(plain) else 0) + known.scale[classes]
                value += np.where(classes < OWN, 0, np.where(place >= 0, seen, known.unseen[classes]))
                text = np.repeat(np.arange(len(chunk)), np.diff(first))
                rare = np.flatnonzero(place < 0)
                rare = rare[np.lexsort((keys[rare], text[rare]))]
                t, k = text[rare], keys[rare]
                lead = np.ones(len(rare), bool)
                lead[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
                where = np.flatnonzero(lead)
                counts = np.diff(np.concatenate([where, [len(rare)]])).astype(np.int32)
                shared_class = np.where(classes[rare[where]] >= OWN, counts, 0).astype(np.int32)
                cuts = np.searchsorted(t[where], np.arange(len(chunk) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (k[where].view(np.int64), counts, shared_class)]
                ids = batch.column(0).slice(chunk.first, len(chunk))
                figures = [chunk.per_text(first, x) for x in ((place >= 0).astype(np.int64), logs, value)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(len(chunk))), ids, pa.array(np.diff(first)), *map(pa.array, figures), *lists],
                    names=["row", "doc_id", "n_tokens", "known", "base", "score", "keys", "counts", "fresh"],
                )
                row += len(chunk)

    return docs.mapInArrow(run, PARTS)


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``, learning from ``training``."""
    spark = docs.sparkSession
    texts = training.select(F.col(text_col).alias("text"))
    vocabulary = stored(word_counts(texts), "vocabulary")
    known = tables(vocabulary)
    model = fit(stored(trigram_counts(texts, spark.sparkContext.broadcast(known)), "trigrams"))
    parts = stored(_scored(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), spark.sparkContext.broadcast((known, model))), "parts")

    rare = parts.select("row", F.explode(F.arrays_zip("keys", "counts", "fresh")).alias("w")).select("row", F.col("w.keys").alias("key"), F.col("w.counts").alias("c"), F.col("w.fresh").alias("f"))
    found = rare.join(vocabulary.select("key", "tail", "n").hint("merge"), "key")
    gain = F.log10(F.col("n") + 0.5) - F.lit(float(np.log10(0.5)))
    # by tail class: from the unseen words' share, which _scored has assumed, to a seen word's
    shift = F.element_at(F.lit([float(x) for x in (known.scale - known.unseen)[OWN:]]), F.col("tail") - OWN + 1)
    mine = F.when(F.col("f") > 0, F.col("f") * (F.log10("n") + shift)).otherwise(0.0)
    sums = found.groupBy("row").agg(F.sum("c").alias("_known"), F.sum(F.col("c") * gain).alias("_base"), F.sum(mine).alias("_score"))
    joined = parts.drop("keys", "counts", "fresh").join(sums.hint("merge"), "row", "left")
    per_token = float(np.log10(known.train_tokens + 0.5 * (known.vocabulary + 1)))
    zero = F.lit(0)
    return joined.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("_known", zero)).alias("n_known"), F.lit(known.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", zero) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), (F.col("score") + F.coalesce("_score", zero)).alias("score"),
    )
