"""Whole-batch tokenisation in numpy: word bounds and 64-bit word hashes of an Arrow string column.

A batch is handled in chunks of whole texts, about ``CHUNK_BYTES`` of UTF-8 each (one longer text is
a chunk of its own), so memory is bounded by the longest text, not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: Bytes from which a range is hashed as a whole.
LONG = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse for i < n, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(20, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Texts ``first`` to ``last`` (exclusive) of a batch as one byte array with their offsets."""

    def __init__(self, first: int, last: int, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.first, self.last, self.raw, self.offsets = first, last, data, offsets
        self.data = _LOWER[data] if lower else data
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return self.last - self.first

    def bounds(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes outside ``separator`` (cut at text ends), and each text's first run (len + 1 entries)."""
        inside = ~separator
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= separator[:-1]
        ends[:-1] &= separator[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        starts[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.bounds(_SPACE[self.data])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range: a polynomial modulo 2**64, and of ranges of ``LONG`` bytes or more a BLAKE2b digest.

        Long strings can be built that agree under any polynomial modulo a power of two (Thue-Morse strings do, from 1024 bytes on).
        """
        up, down = _power_tables(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_CODES[self.data] * up[: len(self.data)], out=self._sums[1:])
        out = mix64((self._sums[ends] - self._sums[starts]) * down[starts])
        for i in np.flatnonzero(ends - starts >= LONG):
            out[i] = int.from_bytes(blake2b(self.data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def per_text(self, first_run: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` over the runs of each text."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[first_run[1:]] - total[first_run[:-1]]


def chunks(column: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        a, b = int(offsets[first]), int(offsets[last])
        yield Chunk(first, last, data[a:b], offsets[first : last + 1] - a, lower)
        first = last


_MULT = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, first_word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` words, and each text's first window; a text of 1 to n - 1 words gives its whole sequence as one."""
    counts = np.diff(first_word)
    windows = np.maximum(counts - n + 1, (counts > 0).astype(counts.dtype))
    first = np.concatenate([[0], np.cumsum(windows)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - first_word[:-1], windows)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out += padded[at + k] * _MULT[k]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        own = words[first_word[i] : first_word[i + 1]]
        out[first[i] : first[i] + 1] = (own * _MULT[: len(own)]).sum(keepdims=True) + _MULT[63 - len(own) : 64 - len(own)]
    return mix64(out), first
