"""Best-fit packing of tokenized documents into sequences, after a dominance reduction (operator 11).

A document's tokens, closed by an end token, are cut into pieces of at most CAPACITY tokens. Lengths are whole numbers
from 1 to CAPACITY, so the whole instance is a table of how many pieces have which length, at most CAPACITY rows at any
number of documents. The plan is made over that table, all pieces of a length at once:

* Dominance (Martello and Toth): a sequence that is at least as good as any other for its longest piece is fixed for
  good. It applies where nothing else fits beside the piece; where a partner fills the sequence exactly; where one
  partner at most fits (the longest is taken); and where two at most fit, and either the longest single partner is no
  shorter than any two together, or the longest partner and the longest beside it dominate every other pair.
* Best fit: what is left goes, longest first, into the fullest sequence that takes it.

Pieces are then numbered within their length, by id, without a task per length, and the plan turns length and number
into sequence and offset. ``lower_bound`` tells how many sequences any packing needs.

Defined results: a null text is the empty text, one piece of the end token; a null id comes first; rows with the
same id are documents of their own; an empty table gives no rows; extra columns are not read; a long text is
encoded word by word and holds its ids only.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .ranks import ranked
from .scratch import stored

CAPACITY = 2048
END = 0
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space to Python, not to the tokenizer: texts with it are cut at ASCII white space only.
_NO_SPACE = re.compile(r"[\x1C-\x1F]")
#: ASCII marks but the apostrophe, at a word's end.
_TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: A character of no text, as a rule, between words that are encoded together, and how many are.
_MARK, _TOGETHER = "\uE000", 256
#: Words of at most so many characters whose ids a worker keeps, and how many.
MEMO_CHARS, MEMO_WORDS = 32, 1 << 19
_CHUNK_CHARS = 1 << 20
_tokenizers: dict[str, tuple] = {}


class WordEncoder:
    """Ids of texts as bytes, each word encoded once.

    The vocabulary's pattern never crosses white space, and never goes on from ASCII letters to ASCII marks other than the
    apostrophe, so words are cut there. New ones are encoded many at a time, parted by a character whose ids tell where each ends;
    words that hold that character, or could hold one of the tokenizer's special tokens, are encoded alone. A worker keeps the ids of
    short words in two generations of some MEMO_WORDS each: when one is full, the one before it goes.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.older = Tokenizer.from_file(path), {}, {}
        self.mark = self._ids([_MARK])

    @classmethod
    def at(cls, path: str) -> WordEncoder:
        if path not in _tokenizers:
            _tokenizers[path] = cls(path)
        return _tokenizers[path]

    def _ids(self, texts: list[str]) -> np.ndarray:
        return np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of each word, from texts of many."""
        ids = self._ids([f" {_MARK} ".join([*words[at : at + _TOGETHER], ""]) for at in range(0, len(words), _TOGETHER)])
        marks = np.flatnonzero(ids[: len(ids) - len(self.mark) + 1] == self.mark[0])
        for k in range(1, len(self.mark)):
            marks = marks[ids[marks + k] == self.mark[k]]
        starts = [0, *(4 * (marks[:-1] + len(self.mark))).tolist()]
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(starts, (4 * marks).tolist(), strict=True)]

    def _look_up(self, words: list[str]) -> None:
        """Put ``words`` into the memo."""
        for w in words:
            if (ids := self.older.get(w)) is not None:
                self.memo[w] = ids
        new = [w for w in words if w not in self.memo]
        alone = [w for w in new if _MARK in w or "<|" in w]
        if alone:
            self.memo |= {w: self._ids([w]).tobytes() for w in alone}
            new = [w for w in new if w not in self.memo]
        if new:
            self.memo.update(zip(new, self._together(new), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words = [_WORD.findall(t) if _NO_SPACE.search(t) else t.split() for t in texts]
        distinct = set().union(*words)
        cut, rest, parts = [], [], set()
        for w in distinct.difference(self.memo):
            bare = w.rstrip(_TAIL)
            if len(bare) < len(w) and bare.isascii() and bare.isalpha():
                cut.append((w, bare, tail := w[len(bare) :]))
                parts |= {bare, tail}
            else:
                rest.append(w)
        self._look_up(list(parts.difference(self.memo).union(rest)))
        self.memo.update((w, self.memo[bare] + self.memo[tail]) for w, bare, tail in cut)
        found = [b"".join(map(self.memo.__getitem__, own)) for own in words]
        for w in [w for w in distinct.union(parts) if len(w) > MEMO_CHARS]:
            del self.memo[w]
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.older = {}, self.memo
        return found


def _cut(path: str, capacity: int, with_ids: bool) -> Callable:
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.at(path), np.array([END], "<u4").tobytes()
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, chars, first = [], 0, at
                while at < batch.num_rows and (not texts or chars < _CHUNK_CHARS):
                    texts.append(batch.column(1)[at].as_py() or "")
                    chars, at = chars + len(texts[-1]), at + 1
                rows: list[tuple] = []
                for row, ids in enumerate(encoder.encode(texts), first):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        rows.append((row, piece, start, len(own) // 4, zlib.crc32(own), own))
                row, *columns, own = zip(*rows, strict=True)
                arrays = [batch.column(0).take(pa.array(row)), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]]
                if with_ids:
                    flat = np.frombuffer(b"".join(own), "<u4").astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(columns[2])]), pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's pieces, and their ids if asked for; ``path`` is a tokenizer's file on all machines."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shape = [StructField("doc_id", rows.schema["doc_id"].dataType), StructField("piece", IntegerType()), *[StructField(c, LongType()) for c in ("start", "length", "ids_crc32")]]
    if with_ids:
        shape.append(StructField("ids", ArrayType(IntegerType())))
    return rows.mapInArrow(_cut(path, capacity, with_ids), StructType(shape))


@dataclass
class Plan:
    """Where the pieces of each length go: from number ``first`` on, ``each`` a sequence, from sequence ``sequence`` and offset ``offset`` on."""

    capacity: int
    left: dict[int, int]
    taken: dict[int, int] = field(default_factory=lambda: defaultdict(int))
    steps: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0

    def put(self, length: int, count: int, each: int, sequence: int, offset: int) -> None:
        """The next ``count`` pieces of ``length``, ``each`` to a sequence."""
        self.steps.append((length, self.taken[length], each, sequence, offset))
        self.taken[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def fix(self, *lengths: int) -> None:
        """As many sequences of these pieces as there are pieces for."""
        times = min(self.left[n] // lengths.count(n) for n in lengths)
        offset = 0
        for n in lengths:
            self.put(n, times, 1, self.sequences, offset)
            offset += n
        self.sequences += times
        self.fixed += times


def _dominating(left: dict[int, int], length: int, capacity: int) -> tuple[int, ...] | None:
    """The pieces of a sequence that dominates every other with a piece of ``length``, if the rules show one."""
    others = dict(left)
    others[length] -= 1
    room = capacity - length
    fitting = sorted(n for n, k in others.items() if k and n <= room)
    if not fitting:
        return (length,)
    longest = fitting[-1]
    small = [n for n in fitting[:3] for _ in range(min(others[n], 3))][:3]
    if longest == room or len(small) < 2 or small[0] + small[1] > room:
        return (length, longest)
    if len(small) == 3 and sum(small) <= room:
        return None
    # two at most fit beside it: for each shorter one, the longest partner
    pairs = []
    for s in fitting:
        partner = next((n for n in reversed(fitting) if n >= s and n + s <= room and (n > s or others[n] > 1)), None)
        if partner:
            pairs.append((s, partner))
    if all(s + n <= longest for s, n in pairs):
        return (length, longest)
    beside = max((s for s in fitting if s + longest <= room and (s < longest or others[s] > 1)), default=0)
    if beside and all(s <= beside or s + n <= longest for s, n in pairs):
        return (length, longest, beside)
    return None


def reduce_(plan: Plan) -> None:
    """Fix dominating sequences until no rule applies; each fix leaves fewer pieces, so rules that failed may apply later."""
    for n in sorted(plan.left, reverse=True):
        other = plan.capacity - n
        if n >= other and n in plan.left and plan.left.get(other, 0) > (n == other):
            plan.fix(n, other)
    moved = True
    while moved:
        moved = False
        for n in sorted(plan.left, reverse=True):
            while n in plan.left and (found := _dominating(plan.left, n, plan.capacity)):
                plan.fix(*found)
                moved = True


def best_fit(plan: Plan) -> None:
    """What is left, longest first, into the fullest sequence with room; sequences that are filled alike are handled together."""
    open_groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, count)

    def fill(room: int, first: int, count: int, n: int) -> None:
        each = room // n
        whole = min(count, plan.left[n] // each)
        if whole:
            plan.put(n, whole * each, each, first, plan.capacity - room)
            open_groups.setdefault(room - each * n, []).append((first, whole))
        rest = plan.left.get(n, 0)
        if whole < count and rest:
            plan.put(n, rest, rest, first + whole, plan.capacity - room)
            open_groups.setdefault(room - rest * n, []).append((first + whole, 1))
            whole += 1
        if whole < count:
            open_groups.setdefault(room, []).append((first + whole, count - whole))

    for n in sorted(plan.left, reverse=True):
        for room in sorted(r for r in open_groups if r >= n):
            groups = open_groups.pop(room)
            while groups and n in plan.left:
                first, count = groups.pop()
                fill(room, first, count, n)
            if groups:
                open_groups.setdefault(room, []).extend(groups)
            if n not in plan.left:
                break
        if n in plan.left:
            count = -(-plan.left[n] // (plan.capacity // n))
            first, plan.sequences = plan.sequences, plan.sequences + count
            fill(plan.capacity, first, count, n)


def plan_of(lengths: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for so many pieces of each length."""
    plan = Plan(capacity, {n: k for n, k in lengths.items() if k})
    reduce_(plan)
    best_fit(plan)
    return plan


def lower_bound(lengths: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: pieces over half, and what the others need beyond the room beside them (L2)."""
    best = -(-sum(n * k for n, k in lengths.items()) // capacity)
    for least in sorted({n for n in lengths if 2 * n <= capacity} | {0}):
        alone = sum(k for n, k in lengths.items() if n > capacity - least)
        large = sum(k for n, k in lengths.items() if capacity - least >= n > capacity / 2)
        beside = capacity * large - sum(n * k for n, k in lengths.items() if capacity - least >= n > capacity / 2)
        medium = sum(n * k for n, k in lengths.items() if capacity / 2 >= n >= least)
        best = max(best, alone + large + max(0, -(-(medium - beside) // capacity)))
    return best


def _placed(steps: np.ndarray) -> Callable:
    """Sequence and offset of rows with length and rank, by the plan's ``steps`` sorted by length and first number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = steps[:, 0] * (1 << 50) + steps[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            step = steps[np.searchsorted(key, length * (1 << 50) + rank, side="right") - 1] if len(steps) else np.zeros((0, 5), np.int64)
            place = rank - step[:, 1]
            sequence, offset = step[:, 3] + place // step[:, 2], step[:, 4] + place % step[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (doc_id, piece, start, length, ..) with the sequence and offset of every piece."""
    cut = stored(cut, "pieces")
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    steps = np.array(sorted(plan_of(lengths, capacity).steps), np.int64).reshape(-1, 5)
    numbered = ranked(cut, "length", ["doc_id", "piece"])
    shape = StructType([*numbered.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return numbered.mapInArrow(_placed(steps), shape).drop("rank")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves; ``packed`` has ids. A sequence holds ``capacity`` tokens at most."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = packed.groupBy("sequence_id").agg(ordered.alias("p"))
    return grouped.select("sequence_id", F.flatten(F.transform("p", lambda p: p["ids"])).alias("ids"), F.transform("p", lambda p: p["doc_id"]).alias("doc_ids"))
