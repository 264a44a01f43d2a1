"""Quality rules as a short-circuit cascade (operator 8).

Base figures of a text come from one vectorised pass. The method's rules are then run one after the
other, each only on the texts that no earlier rule has rejected; some work out figures of their own,
such as word statistics, for those texts alone. Their order is planned on a sample: in every task,
one text of ``SAMPLE`` (by a hash of its id) is put to all rules, which are timed and counted, and
the other texts of the chunk meet the rules by rejection per cost so far, highest first. So the
sample covers the whole table, needs no pass of its own, and nothing goes to the driver. The order
changes the work, and which of several failing rules is named, never the verdict.

Defined results: null is the empty text; a text without words has zeros everywhere, fails the base
rules and is not kept; an empty table gives no rows; repeated rows are judged alike; extra columns
are ignored. Lines are equal byte by byte; words are compared as they stand.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import Chunk, chunks, mix64

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: One text of so many plans the order of the rules.
SAMPLE = 16
#: The symbols that n_symbols counts.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
#: First bytes of letters: ASCII ones, and code points from U+00C0 without U+2000-U+2FFF (signs) and from U+10000 on (pictures).
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xE2), *range(0xE3, 0xF0)]] = True
_FIRST = np.ones(256, bool)
_FIRST[0x80:0xC0] = False


class Facts:
    """Base figures of a chunk's texts; everything else a rule needs is worked out on demand."""

    def __init__(self, chunk: Chunk):
        self.chunk = chunk
        self.starts, self.ends, self.first = chunk.words()
        self.n_words = np.diff(self.first)
        chars = np.concatenate([[0], np.cumsum(_FIRST[chunk.data])])
        self.word_chars = chunk.per_text(self.first, chars[self.ends] - chars[self.starts])
        self.n_symbols = self.count_bytes(_SYMBOL)
        self._lines()
        self._repeats()
        self.base_failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)

    def count_bytes(self, table: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Bytes of each text (of ``rows`` only, else of all) that ``table`` holds."""
        if rows is not None and len(rows) < len(self.chunk) // 2:
            o = self.chunk.offsets
            return np.array([np.count_nonzero(table[self.chunk.data[o[i] : o[i + 1]]]) for i in rows], np.int64)
        total = np.concatenate([[0], np.cumsum(table[self.chunk.data])])[self.chunk.offsets]
        return np.diff(total) if rows is None else np.diff(total)[rows]

    def word_groups(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text in ``rows``: number of distinct words, and how often its most frequent word occurs."""
        counts = self.n_words[rows]
        text = np.repeat(np.arange(len(rows)), counts)
        at = np.arange(counts.sum()) + np.repeat(self.first[rows] - np.cumsum(counts) + counts, counts)
        key = mix64(self.chunk.hashes(self.starts[at], self.ends[at]) + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key)
        key = key[order]
        lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        owner, size = text[order[lead]], np.diff(np.append(lead, len(key)))
        top = np.zeros(len(rows), np.int64)
        np.maximum.at(top, owner, size)
        return np.bincount(owner, minlength=len(rows)), top

    def _lines(self) -> None:
        """Lines with a word, and those among them equal to an earlier line of the text."""
        c = self.chunk
        starts, ends, first = c.bounds(c.data == 10)
        words_to = np.searchsorted(self.starts, ends) - np.searchsorted(self.starts, starts)
        text = np.repeat(np.arange(len(c)), np.diff(first))
        own, text = words_to > 0, text[words_to > 0]
        self.n_lines = np.bincount(text, minlength=len(c))
        key = mix64(c.hashes(starts[own], ends[own]) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, at = np.unique(key, return_index=True)
        self.n_dup_lines = self.n_lines - np.bincount(text[at], minlength=len(c))

    def _repeats(self) -> None:
        """Words that lie in a window of WINDOW words found twice or more in the text."""
        c, n = self.chunk, len(self.starts)
        self.n_repeat_words = np.zeros(len(c), np.int64)
        if n < WINDOW:
            return
        text = np.repeat(np.arange(len(c)), self.n_words)
        at = np.flatnonzero(text[: n - WINDOW + 1] == text[WINDOW - 1 :])
        hashes = c.hashes(self.starts, self.ends)
        key = text[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(WINDOW):
            key = mix64(key * np.uint64(3) + hashes[at + k]) if k % 4 == 3 else key * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, at[again], 1)
        np.add.at(edge, at[again] + WINDOW, -1)
        self.n_repeat_words = c.per_text(self.first, np.cumsum(edge[:-1]) > 0)


def _symbols(f: Facts, rows: np.ndarray) -> np.ndarray:
    return 10 * f.n_symbols[rows] > 3 * f.n_words[rows]


def _word_length(f: Facts, rows: np.ndarray) -> np.ndarray:
    chars, words = f.word_chars[rows], f.n_words[rows]
    return (chars < 2 * words) | (chars > 15 * words)


def _dup_lines(f: Facts, rows: np.ndarray) -> np.ndarray:
    return 100 * f.n_dup_lines[rows] > 35 * f.n_lines[rows]


def _shouting(f: Facts, rows: np.ndarray) -> np.ndarray:
    return 2 * f.count_bytes(_UPPER, rows) > f.word_chars[rows]


def _few_letters(f: Facts, rows: np.ndarray) -> np.ndarray:
    return 2 * f.count_bytes(_LETTER, rows) < f.word_chars[rows]


def _one_word(f: Facts, rows: np.ndarray) -> np.ndarray:
    """One word makes up over 30 % of the text."""
    return 100 * f.word_groups(rows)[1] > 30 * f.n_words[rows]


def _few_distinct(f: Facts, rows: np.ndarray) -> np.ndarray:
    """Under 2 % of the words are distinct."""
    return 100 * f.word_groups(rows)[0] < 2 * f.n_words[rows]


Rule = Callable[[Facts, np.ndarray], np.ndarray]
#: A rule takes the figures and the numbers of the texts still in play, and says which it rejects.
RULES: dict[str, Rule] = {"symbols": _symbols, "word_length": _word_length, "dup_lines": _dup_lines, "shouting": _shouting, "few_letters": _few_letters, "one_word": _one_word, "few_distinct": _few_distinct}


class Plan:
    """What a task has measured of each rule on its sample."""

    def __init__(self, rules: dict[str, Rule]):
        self.rules, self.spent, self.rejected = rules, dict.fromkeys(rules, 1e-9), dict.fromkeys(rules, 0)

    def order(self) -> list[str]:
        return sorted(self.rules, key=lambda n: -self.rejected[n] / self.spent[n])

    def measure(self, facts: Facts, rows: np.ndarray) -> dict[str, np.ndarray]:
        """What each rule says of the sampled texts."""
        said = {}
        for name, rule in self.rules.items():
            began = time.perf_counter()
            said[name] = rule(facts, rows)
            self.spent[name] += time.perf_counter() - began
            self.rejected[name] += int(said[name].sum())
        return said

    def reasons(self, facts: Facts, picked: np.ndarray) -> np.ndarray:
        """Per text "base", the rule that rejects it, or None; texts that are ``picked`` are the sample."""
        why = np.full(len(facts.n_words), None, object)
        why[facts.base_failed] = "base"
        sample, alive = np.flatnonzero(~facts.base_failed & picked), np.flatnonzero(~facts.base_failed & ~picked)
        said = self.measure(facts, sample) if len(sample) else {}
        for name in self.order():
            if said:
                hit = sample[said[name]]
                why[hit[why[hit] == None]] = name  # noqa: E711  elementwise
            if len(alive):
                hit = self.rules[name](facts, alive)
                why[alive[hit]], alive = name, alive[~hit]
        return why


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict[str, Rule] = RULES) -> DataFrame:
    """Per row the base figures, base_failed, kept, and the rule that rejected it in planned order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(rules)
        for batch in batches:
            drawn = mix64(batch.column(0).fill_null(0).to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(SAMPLE) == 0
            for chunk in chunks(batch.column(1)):
                f = Facts(chunk)
                why = plan.reasons(f, drawn[chunk.first : chunk.last])
                ids = batch.column(0).slice(chunk.first, len(chunk))
                figures = [pa.array(x.astype(np.int64)) for x in (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words)]
                yield pa.RecordBatch.from_arrays(
                    [ids, *figures, pa.array(f.base_failed), pa.array(why == None), pa.array(why, pa.string())],  # noqa: E711
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
                )

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, SCHEMA)
