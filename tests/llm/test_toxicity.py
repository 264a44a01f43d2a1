import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakescribe.llm import queries, toxicity


def terms_of(texts, labels):
    rows = []
    for chunk in toxicity.chunks(pa.array(texts), lower=True):
        text, slot = toxicity._distinct(*toxicity._term_slots(chunk))
        rows += [slot[text == i].astype(np.int32) for i in range(len(chunk))]
    return pa.table({"doc": pa.array(range(len(texts))), "slots": pa.array(rows, pa.list_(pa.int32())), "label": pa.array(labels, pa.int32())})


def test_pairs_that_additive_weights_miss():
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"word{rng.randrange(50)}" for _ in range(6)] + ["grout"] * a + ["insul"] * b
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(a and b))
    machine = toxicity.fit(terms_of(texts[:2000], labels[:2000]))
    score = machine.score(pa.array(texts[2000:]))
    assert ((score >= 0.3) == np.array(labels[2000:], bool)).mean() > 0.99
    assert np.abs(machine.factors).max() > 0.1  # pairs have been learned


def test_one_class_gives_the_base_rate():
    machine = toxicity.fit(terms_of(["a b", "c"], [0, 0]))
    assert machine.score(pa.array(["a", None, ""])) == pytest.approx([0.5 / 3] * 3)


def test_raw_is_the_factorization_machine():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(np.arange(5, dtype=np.int32), 0.3, rng.normal(size=5), rng.normal(size=(5, 4)))
    want = 0.3 + m.weights[[0, 2, 4]].sum() + sum(m.factors[i] @ m.factors[j] for i, j in [(0, 2), (0, 4), (2, 4)])
    assert m.raw(np.array([1, 1, 1]), np.array([0, 2, 4]), 2) == pytest.approx([0.3, want])


def test_odd_rows(spark):
    rows = [(i, f"plain words number{i % 7} here") for i in range(90)] + [(100 + i, f"you idiot number{i % 5}") for i in range(20)] + [(200, None), (201, ""), (202, "idiot " * 30_000), (0, "plain words number0 here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("label", F.lit(1))
    labels = spark.createDataFrame([(i, 0) for i in range(90)] + [(100 + i, 1) for i in range(20)] + [(0, None), (7777, 1)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*range(90), 200, 201, 0])
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() in (0, len(rows))


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in queries.op6_toxicity(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(rows[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    yes, no = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no]) > 0.97
    assert np.mean([s >= 0.3 for s in no]) < 0.01


def test_terms_of_a_training_text_are_bounded():
    text, slot = toxicity._distinct(np.repeat([0, 1, 2], [3, 50, 4]), np.concatenate([np.arange(3), np.arange(50) * 7, np.arange(4)]))
    t, s = toxicity._fewer(text, slot, 10)
    assert np.bincount(t).tolist() == [3, 10, 4]
    assert (np.diff(t) >= 0).all() and set(s[t == 1]) < set(slot[text == 1])
    again = toxicity._fewer(text, slot, 10)
    assert (again[1] == s).all()


def test_drop_toxic_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "you fool" if i % 2 else "a calm day") for i in range(40)], "doc_id long, text string").withColumn("_toxicity", F.lit("mine"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r._toxicity for r in kept.collect()} == {"mine"}
