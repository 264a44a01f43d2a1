import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakescribe.llm import lm, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


def base(train, docs):
    counts = Counter(t for x in train for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return n, {i: (len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x))) for i, x in docs}


def test_query_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 600)  # so that the join has work to do
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 1}
    n, want = base([x for i, x in docs if i not in held], docs)
    rows = queries.op10_lm(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, *want[r.doc_id][:2], n)
        assert r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9)
        assert r.score < 0
    mine, plain = (sum(x for x in (getattr(r, c) for r in rows if r.held_out)) for c in ("score", "base_score"))
    assert mine > 0.9 * plain  # scores are negative: the model beats the unigram on held-out texts


def test_scores_are_normalised(spark):
    """In any context, the probabilities of all known tokens and of one unseen word sum to one."""
    rows = [(i, "aa bb cc dd ee ff gg hh"[: 2 + 3 * (i % 8)]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh"]
    probes = spark.createDataFrame([(0, "aa bb"), *((i + 1, f"aa bb {w}") for i, w in enumerate(words))], "doc_id long, text string")
    # a text's score ends with the end token, so compare prefixes through the model itself
    vocabulary = lm.word_counts(docs.select("text")).cache()
    known = lm.tables(vocabulary)
    grams = lm.trigram_counts(docs.select("text"), spark.sparkContext.broadcast(known))
    model = lm.fit(grams)
    for context in (lm.START * (lm.CLASSES + 1) + lm.START, 1 * (lm.CLASSES + 1) + 2):
        r = model.predicted(np.array([context]))
        p = np.exp(r @ model.target.T + model.bias - model.log_norm(np.array([context]))[:, None])
        assert p.sum() == pytest.approx(1, abs=1e-4)
    assert known.vocabulary == 9 and known.train_tokens == sum(len(tokens(t)) for _, t in rows)
    assert all(r.score < 0 for r in lm.score(probes, docs).collect())


def test_shared_classes_sum_to_one():
    known = lm.Tables(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int32), np.zeros(lm.CLASSES), np.zeros(lm.CLASSES), 0, 0)
    assert (known.classes(np.array([lm.END, 5], np.uint64), np.array([0, 450]), np.array([-1, -1])) == [0, 450]).all()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "One two  TWO"), (3, "One two  TWO"), (4, "w " * 20_000), (None, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("row", F.lit(0))
    got = lm.score(docs, docs)
    n, want = base([t for _, t in rows], rows)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (*want[r.doc_id][:2], n)
        assert r.base_score == pytest.approx(want[r.doc_id][2])
    bare = lm.score(docs, docs.limit(0)).collect()
    assert all(abs(r.base_score) < 1e-6 for r in bare) and all(r.n_known == 0 and r.train_tokens == 0 for r in bare)
    assert lm.score(docs.limit(0), docs).count() == 0
