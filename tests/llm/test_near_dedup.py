import random
import re

import numpy as np
from pyspark.sql import functions as F

from lakescribe.llm import near_dedup as nd
from lakescribe.llm import queries, scratch
from lakescribe.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def fixture():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for size in (1, 3, 5, 6, 12, 30, 80, 200, 600):
        for _ in range(6):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for _ in range(rng.choice([1, 2, 4, 25])):
                copy = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                if rng.random() < 0.2:
                    copy.append("extra")
                rows.append((n, rng.choice([" ", "\n", "\t "]).join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
                n += 1
    chain = [f"c{i}" for i in range(120)]  # each step is a link, the ends are not
    for step in range(12):
        rows.append((n, " ".join(chain[step * 2 : step * 2 + 90])))
        n += 1
    line = " ".join(f"common{i}" for i in range(9))
    for i in range(150):
        rows.append((n, line + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 4, 9])))))
        n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, None)]


def test_matches_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("label", F.lit(0)).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.cluster(docs).collect()}
    assert got == brute(rows)
    kept = nd.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in brute(rows).items() if x[2])


def test_small_sets_lose_no_link(spark):
    """Pairs that differ in as many shingles as a link allows, at sizes where a band is often empty."""
    rows, n = [], 0
    for size, tail in ((10, 1), (11, 1), (16, 2), (17, 2), (23, 3), (30, 4)):
        for case in range(40):
            words = [f"s{size}x{case}x{i}" for i in range(size + 4)]
            rows += [(n, " ".join(words)), (n + 1, " ".join(words[: len(words) - tail]))]
            n += 2
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert sum(not kept for _, _, kept in got.values()) > 100


def test_empty_table(spark):
    assert nd.cluster(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op1_near_dedup(spark, sf).collect()}
    assert got == brute(rows)


def test_registers_keep_order_and_top_bits():
    low = np.sort(np.random.default_rng(1).integers(0, 1 << 56, 5000, dtype=np.uint64) >> np.random.default_rng(2).integers(0, 50, 5000, dtype=np.uint64))
    low = np.concatenate([low, np.array([0, 1, 2, 3, (1 << 56) - 1, (1 << 54) - 1, 1 << 53], np.uint64)])
    registers = nd._float_bits(low)
    assert (registers > 0).all()
    for x, r in zip(low.tolist(), registers.tolist(), strict=True):
        bits = x.bit_length()
        assert r >> 10 == 57 - bits
        top = (x << 10 >> (bits - 1) if bits <= 11 else x >> (bits - 11)) & 1023 if x else 0
        assert 1023 - (r & 1023) == top


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7), (100, 102), (100, 102)] + [(200, 200 + i) for i in range(1, 60)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)} | {i: 200 for i in range(200, 260)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chance_agreement_matches_disjoint_sets():
    rng = np.random.default_rng(5)
    for n_a, n_b in ((60, 60), (300, 300), (300, 1200), (20_000, 20_000)):
        agreed = filled = 0
        for _ in range(400):
            rows = []
            for n in (n_a, n_b):
                hashes = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
                bucket = (hashes >> np.uint64(56)).astype(np.int64)
                first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
                registers = np.zeros(nd.BUCKETS, np.uint16)
                registers[bucket[first]] = nd._float_bits(hashes[first] & np.uint64((1 << 56) - 1))
                rows.append(registers)
            agreed += int(((rows[0] == rows[1]) & (rows[0] > 0)).sum())
            filled += int(((rows[0] > 0) | (rows[1] > 0)).sum())
        want = float(nd.agreement_by_chance(np.array([n_a]), np.array([n_b]))[0])
        assert abs(agreed / filled - want) < 4 * (want / filled) ** 0.5 + 1e-9


def test_repeated_rows_and_long_texts(spark):
    """Rows repeated with and without the same id, a text of 300,000 words beside a near copy, clashing columns."""
    long = [f"w{i}" for i in range(300_000)]
    near = " ".join([*long[:150_000], "other", *long[150_001:]])
    rows = [(1, " ".join(long)), (2, near), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "a b c d e f g"), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_near_id": F.lit(1), "shingle": F.lit("x"), "component": F.lit(0)})
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.cluster(docs).collect())
    assert got == [(1, 299_996, 1, True), (2, 299_996, 1, False), (3, 3, 3, True), (3, 3, 3, True), (4, 3, 3, False), (5, 1, 5, True)]
    kept = nd.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 3, 5]


def test_batches_are_bounded(spark):
    name, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        for asked, held in (("64m", scratch.BATCH_BYTES), ("1m", 1 << 20), (str(8 << 20), scratch.BATCH_BYTES)):
            spark.conf.set(name, asked)
            scratch.bound_batches(spark)
            assert spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) == held
    finally:
        spark.conf.set(name, before)
