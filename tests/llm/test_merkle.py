"""The manifest against a plain-Python tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lakescribe.llm import merkle, queries, ranks

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(hashes):
    found = [hashes]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][i : i + 16])) for i in range(0, len(found[-1]), 16)])
    return found


def siblings(found, i):
    out = []
    for row in found[:-1]:
        out.append((i % 16, row[i // 16 * 16 : i // 16 * 16 + 16]))
        i //= 16
    return out


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = levels([leaf(*r) for r in by[s]])
    over = levels([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, row in enumerate(by[s]):
            own, path = leaf(*row), siblings(trees[s], i) + siblings(over, at)
            folded = own
            if row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                folded = leaf(row[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1]), *row[2:])
            proof = ""
            for place, run in path:
                proof += "".join(run[:place] + run[place + 1 :])
                folded = sha("".join([*run[:place], folded, *run[place + 1 :]]))
            root = over[-1][0]
            out.append((row[0], own, trees[s][-1][0], root, sha(proof), folded, folded == root))
    return out


def documents(seed, sizes):
    rng, rows, at = random.Random(seed), [], 0
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Ab C", "plain", "Grüße " * rng.randrange(3), "é" * 300])
            rows.append((at, text, rng.choice(["en", None]), source, rng.choice([None, 5, len(text or "")])))
            at += 1
    rng.shuffle(rows)
    return rows


CASES = {
    "one row": {"a": 1},
    "one source": {"a": 40},
    "single leaves": {None: 1, "": 1, "b": 1},
    "runs that fill and overflow": {None: 16, "a": 17, "ä": 15, "z": 256, "Z": 257, "b": 273},
    "three rounds": {"a": 4100, "b": 4096},
    "many sources": {f"s{i}": 1 + i % 3 for i in range(300)},
}


@pytest.mark.parametrize("name", CASES)
def test_proofs_equal_a_plain_tree(spark, tmp_path, name):
    rows = documents(7, CASES[name])
    spark.createDataFrame(rows, COLUMNS).withColumns({"rank": F.lit(1), "group": F.lit("x"), "_part": F.lit(2), "hash": F.lit("h")}).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op12_merkle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_nulls_and_repeated_rows(spark, tmp_path):
    rows = [(None, "Abc", "en", "a", 3), (None, None, None, None, None), (5, "T", "en", "a", 1), (5, "T", "en", "a", 1), (5, "Other", "en", "a", 1), *documents(3, {"a": 30})]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op12_merkle(spark, str(tmp_path)).collect()]
    want = brute(rows)
    assert sorted(r[:4] for r in want if r[0] == 5) == sorted(r[:4] for r in got if r[0] == 5)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op12_merkle(spark, str(tmp_path)).count() == 0
    assert merkle.build(spark.read.parquet(str(tmp_path / "documents.parquet"))).root is None


def test_the_log_is_gapless_and_in_order_of_completion(spark):
    rows = documents(5, {"a": 700, "b": 16, None: 3})
    manifest = merkle.build(spark.createDataFrame(rows, COLUMNS))
    log = {}
    for r in manifest.log.collect():
        log.setdefault(r.source, {})[r.position] = (r.level, r.hash)
    for source, n in {"a": 700, "b": 16, None: 3}.items():
        own = sorted((r for r in rows if r[3] == source), key=lambda r: r[0])
        want, open_runs = [], [[] for _ in range(9)]

        def done(level, value):
            want.append((level, value))
            open_runs[level].append(value)
            if len(open_runs[level]) == 16:
                run, open_runs[level] = open_runs[level], []
                done(level + 1, sha("".join(run)))

        found = levels([leaf(*r) for r in own])
        for r in own:
            done(0, leaf(*r))
        for level in range(len(found) - 1):
            if open_runs[level] and len(want) < sum(map(len, found)):
                run, open_runs[level] = open_runs[level], []
                done(level + 1, sha("".join(run)))
        assert [log[source][i] for i in range(len(log[source]))] == want, source


def test_full_proofs_fold_to_the_root(spark):
    found = merkle.proofs(merkle.build(spark.createDataFrame(documents(9, {"a": 300, "b": 20}), COLUMNS)))
    for r in found.collect():
        value = r.leaf
        for place, run in zip(r.places, r.runs, strict=True):
            assert run[64 * place : 64 * place + 64] == value
            value = sha(run)
        assert value == r.root


def test_ranks_go_on_over_ranges(spark, tmp_path):
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 40}", i) for i in range(4000)]
    spark.createDataFrame(rows, "g string, i long").repartition(7).write.parquet(str(tmp_path / "rows"))
    got = ranks.ranked(spark.read.parquet(str(tmp_path / "rows")), "g", ["i"]).collect()
    seen = {}
    for g, i in sorted(rows, key=lambda r: r[1]):
        seen.setdefault(g, []).append(i)
    assert {(r.g, r.i, r["rank"]) for r in got} == {(g, i, at) for g, own in seen.items() for at, i in enumerate(own)}
