"""Whitening against numpy over all distinct vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakescribe.llm import queries, whitening

COLUMNS = "vec_id long, embedding array<float>, label int"


def brute(rows, components=4, weights="one"):
    whole = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted(set(map(tuple, (x for _, x in whole)))) if weights == "one" else sorted(map(tuple, (x for _, x in whole)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = lambda x: np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)])
    c = np.array([centred(x) for x in fit])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return {i: (n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), centred(x) @ u / np.sqrt(e), e / np.trace(v)) for i, x in whole}


def check(got, want, components=4):
    assert len(got) == len(want) * components
    by, signs = {}, {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(want)
    for i, (n, deviation, w, explained) in want.items():
        assert sorted(by[i]) == list(range(1, components + 1))
        for k, r in by[i].items():
            assert (r.n, r.deviation) == (n, deviation)
            sign = signs.setdefault(k, np.sign(r.whitened) * np.sign(w[k - 1]))
            assert r.whitened == pytest.approx(sign * w[k - 1], rel=1e-9, abs=1e-9)
            assert r.explained == pytest.approx(explained[k - 1], rel=1e-9)
            assert 0 <= r.identity_error < 1e-6  # the outlier at 0 makes the last case badly conditioned


def vectors(n=300, d=7, seed=1, offset=0.0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + offset
    rows = [(i, [float(c) for c in v[i]], i % 3) for i in range(n)]
    rows += [(1000 + i, rows[5][1], 0) for i in range(200)]  # a hot vector
    return rows


def test_query_over_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    check(queries.op13_whitening(spark, sf).collect(), brute([tuple(r) for r in table.select("vec_id", "embedding").collect()]))


@pytest.mark.parametrize("offset", [0.0, 3.0, 250_000.0])
def test_left_out_rows_hot_vectors_and_far_means(spark, tmp_path, offset):
    rows = vectors(offset=offset)
    rows += [(2000, None, 1), (2001, [1.0, None, *[0.0] * 5], 1), (2002, [float("nan"), *[0.0] * 6], 1), (2003, [float("-inf"), *[0.0] * 6], 1), (2004, [], 1), (2005, [offset or -0.0] * 7, 1)]
    spark.createDataFrame(rows, COLUMNS).withColumns({"key": F.lit(1), "x": F.lit(2), "weight": F.lit(9)}).repartition(4).write.parquet(str(tmp_path / "embeddings.parquet"))
    check(queries.op13_whitening(spark, str(tmp_path)).collect(), brute(rows))


def test_weights_by_count(spark):
    rows = vectors()
    got = whitening.whiten(spark.createDataFrame(rows, COLUMNS).repartition(3), weights="count").collect()
    check(got, brute(rows, weights="count"))
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame(rows, COLUMNS), weights="two")


def test_fewer_dimensions_than_components(spark):
    rows = vectors(d=2)
    check(whitening.whiten(spark.createDataFrame(rows, COLUMNS)).collect(), brute(rows, components=2), components=2)


def test_no_variance(spark):
    got = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(3)], COLUMNS)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, 0.0, None)] * 6
    line = [(i, [float(i), 2.0], 0) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(line, COLUMNS)).collect()
    assert {r.component: (r.whitened is None, r.explained) for r in got} == {1: (False, 1.0), 2: (True, 0.0)}
    assert {r.identity_error for r in got if r.component == 1} == {r.identity_error for r in got} and got[0].identity_error < 1e-12


def test_other_dimensions_and_repeated_ids(spark):
    rows = [*vectors(), (None, [0.5] * 7, 1), (7, [0.25] * 7, 1), (3000, [1.0] * 3, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(got) == 4 * (len(rows) - 1) and sum(r.vec_id == 7 for r in got) == 8 and not any(r.vec_id == 3000 for r in got)


def test_a_deviation_beyond_64_bits_is_null(spark):
    got = whitening.whiten(spark.createDataFrame([(0, [3e7], 0), (1, [-3e7], 0), (2, [0.0], 0)], COLUMNS)).collect()
    assert {r.vec_id: r.deviation for r in got} == {0: None if (3 * 256 * 3 * 10**7) ** 2 >= 2**63 else (3 * 256 * 3 * 10**7) ** 2, 1: None if (3 * 256 * 3 * 10**7) ** 2 >= 2**63 else (3 * 256 * 3 * 10**7) ** 2, 2: 0}


def test_empty_tables(spark):
    for rows in ([], [(1, None, 0)]):
        got = whitening.whiten(spark.createDataFrame(rows, COLUMNS))
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
