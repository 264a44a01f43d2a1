"""Packing against the tokenizer library, brute force and bounds."""

import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakescribe.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string, lang string"


def fewest(lengths, capacity):
    """The optimum, by search over subsets."""
    items = sorted(lengths, reverse=True)

    @lru_cache(maxsize=None)
    def solve(rest, room):
        if not rest:
            return 0
        best = None
        for i in sorted(set(range(len(rest))), key=lambda i: -rest[i]):
            if i and rest[i] == rest[i - 1]:
                continue
            left = rest[:i] + rest[i + 1 :]
            if rest[i] <= room:
                cost = solve(left, room - rest[i])
            else:
                cost = 1 + solve(left, capacity - rest[i])
            best = cost if best is None else min(best, cost)
        return best

    return solve(tuple(items), 0)


def checked(plan, lengths, capacity):
    """Places of all pieces are disjoint, gapless and within sequences; gives the number of sequences."""
    by, steps = {}, {}
    for step in sorted(plan.steps):
        steps.setdefault(step[0], []).append(step)
    for n, count in lengths.items():
        for rank in range(count):
            step = [s for s in steps[n] if s[1] <= rank][-1]
            place = rank - step[1]
            by.setdefault(step[3] + place // step[2], []).append((step[4] + place % step[2] * n, n))
    for own in by.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= capacity
    assert sorted(by) == list(range(plan.sequences))
    return len(by)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=40), st.integers(20, 30))
def test_plans_are_whole_and_near_the_bound(lengths, capacity):
    counts = Counter(lengths)
    used = checked(packing.plan_of(counts, capacity), counts, capacity)
    bound = packing.lower_bound(counts, capacity)
    assert bound <= used <= 1.25 * bound + 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(2, 12), min_size=1, max_size=8))
def test_reduction_keeps_an_optimum(lengths):
    """Fixed sequences plus the optimum of what is left is the optimum of the whole."""
    plan = packing.Plan(12, dict(Counter(lengths)))
    packing.reduce_(plan)
    rest = [n for n, k in plan.left.items() for _ in range(k)]
    assert plan.sequences + fewest(tuple(rest), 12) == fewest(tuple(lengths), 12)
    assert packing.lower_bound(Counter(lengths), 12) <= fewest(tuple(lengths), 12)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(4, 24), min_size=1, max_size=8))
def test_reduction_keeps_an_optimum_with_large_pieces(lengths):
    """The same where two at most fit beside a piece, so that the later rules apply."""
    plan = packing.Plan(24, dict(Counter(lengths)))
    packing.reduce_(plan)
    rest = [n for n, k in plan.left.items() for _ in range(k)]
    assert plan.sequences + fewest(tuple(rest), 24) == fewest(tuple(lengths), 24)


def test_every_rule_fixes():
    for lengths, want in [({12: 1}, 1), ({9: 2, 3: 2}, 2), ({8: 1, 3: 1, 2: 1, 10: 1}, 2), ({7: 1, 5: 1, 2: 2}, 1), ({6: 1, 3: 2, 2: 1}, 1)]:
        plan = packing.Plan(12, dict(lengths))
        packing.reduce_(plan)
        assert plan.fixed >= want, lengths


def test_best_fit_equals_one_piece_at_a_time():
    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.choice([rng.randint(1, 60), rng.randint(1, 8), 17]) for _ in range(rng.randint(1, 200))]
        plan = packing.Plan(64, dict(Counter(lengths)))
        packing.best_fit(plan)
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = [r for r in rooms if r >= n]
            room = min(fit) if fit else 64
            if fit:
                rooms.remove(room)
            rooms.append(room - n)
        assert plan.sequences == len(rooms) == checked(plan, Counter(lengths), 64)


def test_huge_counts_cost_nothing():
    lengths = {n: 10**9 + n for n in range(1, 2049)}
    plan = packing.plan_of(lengths)
    assert plan.sequences <= 1.0001 * packing.lower_bound(lengths) and len(plan.steps) < 20_000


def check_rows(got, docs):
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for doc_id, text, *_ in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[start : start + 2048], "<u4")
            want.setdefault((doc_id, piece, start, len(own), zlib.crc32(own.tobytes())), 0)
            want[doc_id, piece, start, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 2048
    lengths = Counter(r.length for r in got)
    assert packing.lower_bound(lengths) <= len(by) <= 1.01 * packing.lower_bound(lengths) + 1
    return len(by)


def test_query_over_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_rows(queries.op11_packing(spark, sf).collect(), docs)


ODD = [
    (1, None), (2, ""), (3, "  \n "), (4, "It's John's, they'll! \x1c a\x1cb  c d"), (5, "<|endoftext|> x <|startoftext|>y"), (6, "é ́x İİ ΑΣ Σ"),
    (7, "日本語 text 数12a3 🎉🎉"), (8, "x" * 5000), (9, "word " * 9000), (9, "word " * 9000), (None, "none"), (10, "a\x85b c \x1f\x0b\x0c d"), *[(100 + i, "same text") for i in range(300)],
]


def test_odd_texts_hot_lengths_and_clashing_columns(spark, tmp_path):
    frame = spark.createDataFrame([(*r, "en") for r in ODD], COLUMNS).withColumns({"length": F.lit(1), "rank": F.lit(2), "piece": F.lit("p"), "_part": F.lit(0)})
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    check_rows(queries.op11_packing(spark, str(tmp_path)).collect(), ODD)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op11_packing(spark, str(tmp_path)).count() == 0


def test_sequences_hold_their_pieces(spark):
    docs = spark.createDataFrame([(i, "some words here " * (i * 7 % 50)) for i in range(60)], "doc_id long, text string")
    packed = packing.pack(packing.pieces(docs, PATH, capacity=100, with_ids=True), 100)
    found = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        own = found[r.sequence_id]
        assert own.ids[r.offset : r.offset + r.length] == r.ids and r.doc_id in own.doc_ids
    assert all(len(r.ids) <= 100 for r in found.values())


def test_an_alternating_memo_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 3)
    encoder, tokenizer = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for text in ["a b c d e", "a f", "b " + "x" * 40, "a b c", ""]:
        assert np.frombuffer(encoder.encode([text, text])[1], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
