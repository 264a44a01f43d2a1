"""Byte-level BPE encoding and decoding as a monoid tree reduction (operator 7).

A text is split by the tokenizer's pattern and every match (piece) is encoded by itself: its bytes are
the leaves of a tree, and neighbouring blocks are joined, level by level, up to the whole piece. A
token list is the encoding of its bytes if and only if every token encodes to itself and every
neighbouring pair, encoded alone, stays that pair; so a join looks at the pair at the seam. Where it
is stable, both lists stand as they are. Else a window around the seam is encoded again, two tokens
first, and it is done as soon as the pairs at the window's two edges are stable, because all other
pairs are stable already. An unstable edge grows the window on its side, twofold each time; at worst
it spans both blocks. Decoding is concatenation, which goes up the same tree.

The tree is reduced for all new pieces of a chunk of texts at once, in numpy: a level's seams are
looked up together among the pairs encoded before, in a sorted table of ``PAIRS`` at most. What each
piece encodes to is remembered, up to ``CACHE`` pieces a task. Both are memories: an entry that is
gone is worked out again.

Ranks are a plain dict (some 50,000 byte strings), shipped to the tasks as a broadcast of that
bounded size. Special tokens are ordinary text here.

Defined results: null is the empty text, which has no tokens and decodes to no bytes; an empty table
gives no rows; repeated rows are encoded alike; extra columns are ignored. Memory for a text, or for
one piece as long as a text, is in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import chunks

CACHE, PAIRS = 200_000, 1 << 19
#: Remembered tokens, whatever the number of pieces.
CACHE_TOKENS = 1 << 21
#: Byte strings up to this length are merged together in numpy, longer ones one by one.
SHORT = 64
_NONE = 1 << 60
SLICE = 1 << 16
CHUNK_BYTES = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines: base64 of the token's bytes, space, rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, .. (counts[0] of them), starts[1], .."""
    upto = np.cumsum(counts)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - counts), counts)


class TreeEncoder:
    """Encodes pieces of bytes; ``ranks`` maps the bytes of each token to its id, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        self._pairs, self._merged = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2  # noqa: B905
        self._bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        ids = sorted(self.bytes_of)
        self._length = np.zeros(ids[-1] + 1 if ids else 0, np.int64)
        self._length[ids] = [len(self.bytes_of[i]) for i in ids]
        self._first = np.cumsum(self._length) - self._length
        self._blob = np.frombuffer(b"".join(map(self.bytes_of.__getitem__, ids)), np.uint8)
        #: joins looked at, those whose seam was stable, windows grown
        self.seams = self.stable_seams = self.grown = 0
        self._forget()

    def _forget(self) -> None:
        """Empties the memory of pairs: sorted keys, and by key whether it is stable and where its encoding is."""
        self._keys, self._is_stable = np.zeros(0, np.int64), np.zeros(0, bool)
        self._at, self._n, self._known = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Encoding by merging the pair of lowest rank, leftmost first, until none is left."""
        ranks, n = self.ranks, len(piece)
        end, back = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts at a place: its end, and the start of the one before
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] == n or end[end[i]] != stop:
                continue  # one of the pair is gone or longer by now
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                back[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if back[i] >= 0 and (r := ranks.get(piece[back[i] : stop])) is not None:
                heapq.heappush(heap, (r, back[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair of ids merges to, _NONE where it is no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where((self._pairs[at] == key) & (left >= 0) & (right >= 0), self._merged[at], _NONE)

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """``merge`` for many byte strings: short ones of like length together."""
        out: list[list[int]] = [[]] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        below = 0
        for width in (4, 8, 16, 32, SHORT):
            rows = np.flatnonzero((lengths > below) & (lengths <= width)) if len(self._pairs) else []
            below = width
            if len(rows):
                for row, ids in zip(rows.tolist(), self._merge_rows([pieces[i] for i in rows.tolist()], lengths[rows])):  # noqa: B905
                    out[row] = ids
        for row in np.flatnonzero(lengths > (SHORT if len(self._pairs) else 0)).tolist():
            out[row] = self.merge(pieces[row])
        return out

    def _merge_rows(self, pieces: list[bytes], lengths: np.ndarray) -> list[list[int]]:
        width = int(lengths.max())
        place = np.arange(width + 1)
        tokens = np.full((len(pieces), width + 1), -1, np.int64)
        tokens[place < lengths[:, None]] = self._bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width + 1), _NONE, np.int64)
        ranks[:, :-1] = self._pair_ranks(tokens[:, :-1], tokens[:, 1:])
        out, rows = [[]] * len(pieces), np.arange(len(pieces))
        while len(rows):
            at = ranks.argmin(1)
            every = np.arange(len(rows))
            low = ranks[every, at]
            done = low == _NONE
            if done.any():
                for row, ids in zip(rows[done].tolist(), tokens[done].tolist()):  # noqa: B905
                    out[row] = [i for i in ids if i >= 0]
                rows, tokens, ranks, at, low = rows[~done], tokens[~done], ranks[~done], at[~done], low[~done]
                every = np.arange(len(rows))
                if not len(rows):
                    break
            tokens[every, at] = low
            shift = np.minimum(place + (place > at[:, None]), width)
            tokens, ranks = np.take_along_axis(tokens, shift, 1), np.take_along_axis(ranks, shift, 1)
            tokens[:, width], ranks[:, width] = -1, _NONE
            ranks[every, at] = self._pair_ranks(low, tokens[every, at + 1])
            inner = np.flatnonzero(at)
            ranks[inner, at[inner] - 1] = self._pair_ranks(tokens[inner, at[inner] - 1], low[inner])
        return out

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs of ids in the memory of pairs; those not there are encoded and put in."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self._keys, key)
        known = self._keys[np.minimum(at, len(self._keys) - 1)] == key if len(self._keys) else np.zeros(len(key), bool)
        if known.all():
            return at
        new = np.unique(key[~known])
        ids = [(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()]
        encoded = self.merge_all([self.bytes_of[a] + self.bytes_of[b] for a, b in ids])
        counts = np.array([len(x) for x in encoded], np.int64)
        place = np.searchsorted(self._keys, new)
        self._keys = np.insert(self._keys, place, new)
        self._is_stable = np.insert(self._is_stable, place, [tuple(x) == p for x, p in zip(encoded, ids)])  # noqa: B905
        self._at = np.insert(self._at, place, len(self._known) + np.cumsum(counts) - counts)
        self._n = np.insert(self._n, place, counts)
        self._known = np.concatenate([self._known, np.fromiter(chain.from_iterable(encoded), np.int64)])
        return np.searchsorted(self._keys, key)

    def stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Do pairs of tokens, encoded alone, stay as they are?"""
        at = self._look_up(left, right)
        return self._is_stable[at]

    def _join(self, tokens: np.ndarray, low: np.ndarray, seam: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Joins the blocks tokens[low:seam] and tokens[seam:high], for many seams in ascending order.

        Gives the new tokens, and the starts of the windows encoded again with how much longer each has become.
        """
        pair = self._look_up(tokens[seam - 1], tokens[seam])
        self.seams += len(seam)
        self.stable_seams += int(self._is_stable[pair].sum())
        todo = np.flatnonzero(~self._is_stable[pair])
        pair, low, seam, high = pair[todo], low[todo], seam[todo], high[todo]
        first, last = seam - 1, seam + 1
        count = self._n[pair]
        fresh = self._known[_ragged(self._at[pair], count)]  # the windows' encodings, one after the other
        start = np.cumsum(count) - count
        still = np.arange(len(todo))
        while len(still):
            left, right = still[first[still] > low[still]], still[last[still] < high[still]]
            left = left[~self.stable(tokens[first[left] - 1], fresh[start[left]])]
            right = right[~self.stable(fresh[start[right] + count[right] - 1], tokens[last[right]])]
            still = np.union1d(left, right)
            if not len(still):
                break
            self.grown += len(still)
            first[left] = np.maximum(low[left], 2 * first[left] - seam[left])
            last[right] = np.minimum(high[right], 2 * last[right] - seam[right])
            encoded = self.merge_all([b"".join(map(self.bytes_of.__getitem__, tokens[a:b].tolist())) for a, b in zip(first[still].tolist(), last[still].tolist())])  # noqa: B905
            count[still] = [len(x) for x in encoded]
            start[still] = len(fresh) + np.cumsum(count[still]) - count[still]
            fresh = np.concatenate([fresh, np.fromiter(chain.from_iterable(encoded), np.int64)])
        more = count - (last - first)
        moved, inside = np.zeros(len(tokens) + 1, np.int64), np.zeros(len(tokens) + 1, np.int64)
        moved[last] = more
        inside[first] += 1
        inside[last] -= 1
        moved, kept = np.cumsum(moved)[:-1], np.flatnonzero(np.cumsum(inside)[:-1] == 0)
        out = np.empty(len(tokens) + int(more.sum()), np.int64)
        out[kept + moved[kept]] = tokens[kept]
        out[_ragged(first + np.cumsum(more) - more, count)] = fresh[_ragged(start, count)]
        return out, first, more

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces one after the other, and where each piece's begin (len + 1 entries)."""
        if len(self._keys) > PAIRS:
            self._forget()
        whole = [self.ranks.get(p, -1) for p in pieces]
        split = [p for p, w in zip(pieces, whole) if w < 0]  # noqa: B905
        blocks = np.array([len(p) for p in split], np.int64)
        tokens = self._bytes[np.frombuffer(b"".join(split), np.uint8)]
        offsets = np.arange(len(tokens) + 1)
        while len(blocks) and blocks.max() > 1:
            before = np.cumsum(blocks) - blocks
            place = np.arange(len(offsets) - 1) - np.repeat(before, blocks)
            left = np.flatnonzero((place % 2 == 0) & (place + 1 < np.repeat(blocks, blocks)))
            tokens, changed, more = self._join(tokens, offsets[left], offsets[left + 1], offsets[left + 2])
            offsets = np.append(offsets[:-1][place % 2 == 0], offsets[-1])
            offsets = offsets + np.concatenate([[0], np.cumsum(more)])[np.searchsorted(changed, offsets)]
            blocks = (blocks + 1) // 2
        each = np.concatenate([np.zeros(1, np.int64), np.cumsum(blocks)])
        ends = offsets[each] if len(offsets) else each
        single = np.array(whole, np.int64)
        counts = np.ones(len(pieces), np.int64)
        counts[single < 0] = np.diff(ends)
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        out = np.empty(at[-1], np.int64)
        alone = np.zeros(at[-1], bool)
        alone[at[:-1][single >= 0]] = True
        out[alone], out[~alone] = single[single >= 0], tokens
        return out, at

    def encode(self, piece: bytes) -> list[int]:
        return self.encode_all([piece])[0].tolist()

    def decode_all(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of token lists one after the other, and where each list's begin; an unknown id is an error."""
        if len(tokens) and not (0 <= tokens.min() and tokens.max() < len(self._length) and self._length[tokens].all()):
            raise KeyError("a token that the ranks do not hold")
        lengths = self._length[tokens]
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        return self._blob[_ragged(self._first[tokens], lengths)], upto[offsets]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class TextEncoder:
    """Splits texts by ``pattern`` and encodes the pieces; remembers what pieces encode to."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.tree, self.pattern = TreeEncoder(ranks), regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._tokens, self._ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self._used = 0

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces that are not remembered."""
        tokens, offsets = self.tree.encode_all([p.encode() for p in pieces])
        n = len(self._place)
        while self._used + len(tokens) > len(self._tokens):
            self._tokens = np.concatenate([self._tokens, np.zeros_like(self._tokens)])
        while n + len(pieces) + 1 > len(self._ends):
            self._ends = np.concatenate([self._ends, np.zeros_like(self._ends)])
        self._tokens[self._used : self._used + len(tokens)] = tokens
        self._ends[n + 1 : n + 1 + len(pieces)] = self._used + offsets[1:]
        self._place.update(zip(pieces, range(n, n + len(pieces))))  # noqa: B905
        self._used += len(tokens)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces one after the other, and where each piece's begin."""
        if len(self._place) > CACHE or self._used > CACHE_TOKENS:
            self._forget()
        places = np.fromiter(map(self._place.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(places < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys(map(pieces.__getitem__, missing))))
            places[missing] = [self._place[pieces[i]] for i in missing]
        starts = self._ends[places]
        counts = self._ends[places + 1] - starts
        return self._tokens[_ragged(starts, counts)], np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts one after the other, and where each text's begin; very long texts go in slices of pieces."""
        if sum(map(len, texts)) < 1 << 22:
            split = [self.pattern.findall(t) for t in texts]
            tokens, offsets = self._encoded(list(chain.from_iterable(split)))
            return tokens, offsets[np.concatenate([np.zeros(1, np.int64), np.cumsum([len(s) for s in split], dtype=np.int64)])]
        parts, counts = [np.zeros(0, np.int32)], [0]
        for text in texts:
            matches = (m[0] for m in self.pattern.finditer(text))
            counts.append(0)
            while some := list(islice(matches, SLICE)):
                parts.append(self._encoded(some)[0])
                counts[-1] += len(parts[-1])
        return np.concatenate(parts), np.cumsum(counts)

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.array([data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary())  # noqa: B905


_encoders: dict[tuple[str, str], TextEncoder] = {}


def _worker_encoder(digest: str, pattern: str, ranks) -> TextEncoder:
    """This Python worker's encoder, kept from task to task with what it remembers."""
    if (digest, pattern) not in _encoders:
        _encoders.clear()
        _encoders[digest, pattern] = TextEncoder(ranks.value, pattern)
    return _encoders[digest, pattern]


def _shared(spark, ranks_path: str):
    """(broadcast of the ranks, digest of them)"""
    ranks = load_ranks(ranks_path)
    digest = hashlib.sha256(b"".join(b"%d %d " % (len(t), r) + t for t, r in ranks.items())).hexdigest()
    return spark.sparkContext.broadcast(ranks), digest


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, tokens array<int>) per row; with ``decoded`` also the bytes that the tokens decode to."""
    ranks, digest = _shared(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(digest, pattern, ranks)
        for batch in batches:
            for chunk in chunks(batch.column(1), size=CHUNK_BYTES):
                raw = memoryview(chunk.raw)
                cuts = chunk.offsets.tolist()
                tokens, offsets = encoder.encode_all([str(raw[a:b], "utf-8") for a, b in zip(cuts, cuts[1:])])  # noqa: B905
                columns = [batch.column(0).slice(chunk.first, len(chunk)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens.astype(np.int32)))]
                if decoded:
                    columns.append(_binary(*encoder.tree.decode_all(tokens, offsets)))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tokens", "decoded"][: len(columns)])

    schema = "doc_id long, tokens array<int>" + ", decoded binary" * decoded
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, decoded binary) per row; null tokens decode to no bytes, an unknown id is an error."""
    ranks, _ = _shared(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TreeEncoder(ranks.value)
        for batch in batches:
            lists = [x.as_py() or [] for x in batch.column(1)]
            tokens = np.fromiter(chain.from_iterable(lists), np.int64)
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in lists], dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(*tree.decode_all(tokens, offsets))], names=["doc_id", "decoded"])

    return encoded.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{tokens_col}` as tokens").mapInArrow(run, "doc_id long, decoded binary")
