"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for operators 3, 5, 8 and 9."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakescribe.llm import exact_dedup, mixing, quality, tokens, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


# 9


def brute_dedup(rows):
    keys = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in rows]
    groups = {}
    for key, (i, t, _) in zip(keys, rows, strict=True):
        groups.setdefault(key, []).append((-len(t or ""), i is None, i))
    return sorted(((i, min(groups[k])[2], len(groups[k]), hashlib.sha256(k.encode()).hexdigest()) for k, (i, _, _) in zip(keys, rows, strict=True)), key=str)


@pytest.mark.parametrize("bits", [None, 64])
def test_exact_dedup(spark, monkeypatch, bits):
    if bits:  # a filter far too small only sends more rows to the exact step; several blocks cover all rows
        monkeypatch.setattr(exact_dedup, "filter_shape", lambda rows: (4, bits))
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab \t\n\u00a0é") for _ in range(rng.randrange(6))), "s") for i in range(300)]
    rows += [(1000, None, None), (1001, "", "s"), (1002, " \n", "s"), (1003, "x" * 200_000, "s"), (1004, "x " * 200_000, "s"), (5, rows[5][1], "s")]
    df = docs_of(spark, rows).withColumn("_x", F.lit(1)).withColumn("kept", F.lit("clash")).repartition(4)
    report = exact_dedup.duplicate_report(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in report), key=str) == brute_dedup(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in report)
    kept = exact_dedup.dedup(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, keep, *_ in brute_dedup(rows) if i == keep)
    assert exact_dedup.dedup(df.limit(0)).count() == exact_dedup.duplicate_report(df.limit(0)).count() == 0


def _shuffled(spark, run):
    """Records that the shuffles of ``run`` write, by the status store of the session."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark._jvm.java.util.ArrayList()
    quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    total = lambda: sum(x.shuffleWriteRecords() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(none, False, False, quantiles, none)))
    before = total()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def test_unique_rows_do_not_shuffle(spark):
    slim = exact_dedup.slim_rows(docs_of(spark, [(i, f"text {i}", "s") for i in range(30_000)]), "doc_id", "text")
    flagged = []
    assert _shuffled(spark, lambda: flagged.append(exact_dedup.stored(exact_dedup.probed(slim, slim, 30_000, 2), "flagged"))) <= 64
    assert flagged[0].filter("maybe").count() < 0.03 * 30_000
    assert _shuffled(spark, lambda: slim.groupBy("key").count().collect()) >= 30_000  # what grouping all rows would take


@pytest.mark.parametrize("least", [1, 2])
def test_bitmap_counts_marks(spark, monkeypatch, least):
    monkeypatch.setattr(exact_dedup, "PIECE_WORDS", 4)
    hits = spark.createDataFrame([(k * k % 700,) for k in range(1500)], "hash long").repartition(5)
    times = {}
    for row in hits.select(*exact_dedup._positions(F.col("hash"), 4096)).collect():
        for p in row:
            times[p] = times.get(p, 0) + 1
    words = exact_dedup.bitmap(hits, 4096, least)
    assert [p for p in range(4096) if int(words[p >> 6]) >> (p & 63) & 1] == sorted(p for p, n in times.items() if n >= least)
    assert not exact_dedup.bitmap(hits.limit(0), 4096, least).any()


def test_false_alarms_do_not_grow(monkeypatch, spark):
    """The filter's bits follow the rows at any size; beyond a block's size there are more blocks, and alarms stay as few."""
    for rows in (1, 1000, 10**6, 10**8, 10**10):
        blocks, bits = exact_dedup.filter_shape(rows)
        assert bits <= exact_dedup.BLOCK_BITS and blocks * bits >= exact_dedup.BITS_PER_ROW * rows
    monkeypatch.setattr(exact_dedup, "BLOCK_BITS", 1 << 15)
    slim = exact_dedup.slim_rows(docs_of(spark, [(i, f"text {i % 19_000}", "s") for i in range(20_000)]), "doc_id", "text")
    assert exact_dedup.filter_shape(20_000) == (16, 1 << 15)
    flagged = exact_dedup.probed(slim, slim, 20_000, 2)
    assert flagged.count() == 20_000
    assert 2000 <= flagged.filter("maybe").count() < 2000 + 0.03 * 18_000


# 5


def brute_targets(sizes):
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, set(sizes), sum(sizes.values())
    while free:
        level = left / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * level > 3 * sizes[s]]
        if not over:
            return target | {s: weights[s] * level for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(40)), rng.choice(["hot"] * 40 + ["a", "b", "c", "ü", "Z", None])) for i in range(4000)]
    rows += [(9001, None, "empty"), (9002, "", "empty"), (9003, "w " * 50_000, "long"), (1, rows[1][1], rows[1][2])]
    df = docs_of(spark, rows).withColumn("target", F.lit("clash")).withColumn("weight", F.lit(1)).repartition(5)
    got = mixing.with_copies(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert (r._mix_size, r._mix_source_size) == (len(WORD.findall(r.text or "")), sizes[r.source])
        assert r._mix_target == pytest.approx(want[r.source])
        assert 0 <= r._mix_copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r._mix_size * r._mix_copies
    assert len(got) == len(rows) and sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in ("hot", "a", "b", "c", "ü", "Z", None):
        assert taken[s] == pytest.approx(want[s], rel=0.1, abs=200)
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r._mix_copies for r in got)
    clash = mixing.mix_documents(df.withColumns({"_mix_size": F.lit("mine"), "_mix_copies": F.lit("own"), "row": F.lit("r"), "id": F.lit("i")}))
    assert {(r._mix_size, r._mix_copies, r["row"], r["id"]) for r in clash.collect()} == {("mine", "own", "r", "i")} and clash.count() == mixed.count()
    assert sorted(map(str, mixing.with_copies(df.repartition(3)).select("doc_id", "_mix_copies").collect())) == sorted(str(r) for r in mixing.with_copies(df).select("doc_id", "_mix_copies").collect())
    assert mixing.mix_documents(df.limit(0)).count() == 0


# 3


def test_url_rules_and_parts(spark):
    urls = [None, "", "no-scheme.example.com/x", "http://Example.NET/en/1", "https://a.example.net/de/", "http://example.com/de/x?y#z", "http://notexample.com/de/x", "http://x.org/fr/", "http://org/fr/a", "http://a.b//://c", "x://h#f/", "http://h?q=/a", "http://UP.com/PATH", "http://a.example.com"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("bad", F.lit(1))
    labels = spark.createDataFrame([(12, 1, 1), (12, 0, 0), (999, 1, 0)], "doc_id long, toxic int, quality int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("example.net", "/en/1", "example.net/en/", "allow"), 4: ("a.example.net", "/de/", "net/", "block"),
        5: ("example.com", "/de/x", "example.com/de/", "block"), 6: ("notexample.com", "/de/x", None, "allow"), 7: ("x.org", "/fr/", "org/fr/", "allow"), 8: ("org", "/fr/a", "org/fr/", "allow"),
        9: ("a.b", "//://c", None, "allow"), 10: ("h", "", None, "allow"), 11: ("h", "", None, "allow"), 12: ("up.com", "/PATH", None, "allow"), 13: ("a.example.com", "", None, "allow"),
    }
    assert url_filter.judge(pages, labels).count() == len(urls) + 1
    assert url_filter.judge(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, labels.limit(0)).collect()} == {"allow", "block"}


def test_bad_hosts_are_blocked(spark):
    pages = [(i, f"http://{'bad' if i % 4 == 0 else 'good' if i % 4 < 3 else 'rare%d' % i}.site.com/x") for i in range(400)]
    labels = [(i, int(i % 4 == 0), 1) for i in range(400) if i % 4 < 3]
    judged = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")).collect()
    assert {r.host: r.verdict for r in judged if "rare" not in r.host} == {"bad.site.com": "block", "good.site.com": "allow"}
    assert {r.verdict for r in judged if "rare" in r.host} == {"allow"}


def test_registered_domains(spark):
    hosts = {"a.b.com": ("b.com", "com"), "a.b.co.uk": ("b.co.uk", "co.uk"), "me.github.io": ("me.github.io", "github.io"), "10.1.2.3": ("10.1.2.3", "10.1.2.3"), "u@a.b.org:80": ("b.org", "org"), "com": ("com", "com"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r.h: (r.d, r.s) for r in df.select("h", url_filter.domain_of(F.col("h")).alias("d"), url_filter.suffix_of(F.col("h")).alias("s")).collect()}
    assert got == hosts


def test_posterior_matches_plain_python(spark):
    """The three levels worked out again by hand, on hosts whose bad rates differ by design."""
    rng = random.Random(2)
    rates = {f"{h}.{d}": rate for d, base in (("a.co.uk", 0.1), ("b.co.uk", 0.6), ("c.org", 0.2), ("d.org", 0.3)) for h, rate in (("x", base), ("y", min(1, base + 0.3)), ("z", base))}
    pages, labels = [], []
    for i in range(3000):
        host = rng.choice(sorted(rates))
        pages.append((i, f"http://{host}/en/{i}" + "p" * (50_000 if i == 7 else 0)))
        if i % 3:
            labels.append((i, int(rng.random() < rates[host]), 1))
    bad = {i: t for i, t, _ in labels}
    count = {}
    for i, url in pages:
        n, b = count.get(host := url.split("/")[2], (0, 0))
        count[host] = (n + (i in bad), b + bad.get(i, 0))

    def strength(rows):
        t, b, k = sum(n for n, _ in rows), sum(b for _, b in rows), len(rows)
        p = b / t
        left = t - sum(n * n for n, _ in rows) / t
        v = (sum(b * b / n for n, b in rows) - b * p - (k - 1) * p * (1 - p)) / left if k > 1 and left else 0
        return min(max(p * (1 - p) / v - 1 if v > 0 else 200, 4), max(min(t, 200), 4))

    def up(rows, cut):
        out = {}
        for name, (n, b) in rows.items():
            key = cut(name)
            out[key] = (out.get(key, (0, 0))[0] + n, out.get(key, (0, 0))[1] + b)
        return out

    def prior(rows, below, cut, mean, m):
        return {k: ((b + m(k) * mean(k)) / (n + m(k)), strength([x for name, x in below.items() if cut(name) == k])) for k, (n, b) in rows.items()}

    domains = up(count, lambda h: h.split(".", 1)[1])
    suffixes = up(domains, lambda d: d.split(".", 1)[1])
    overall = (sum(b for _, b in count.values()) + 0.5) / (sum(n for n, _ in count.values()) + 1)
    top = prior(suffixes, domains, lambda d: d.split(".", 1)[1], lambda _: overall, lambda _: strength(list(suffixes.values())))
    mid = prior(domains, count, lambda h: h.split(".", 1)[1], lambda d: top[d.split(".", 1)[1]][0], lambda d: top[d.split(".", 1)[1]][1])
    want = {}
    for host, (n, b) in count.items():
        mean, m = mid[host.split(".", 1)[1]]
        a, c = b + m * mean, n - b + m * (1 - mean)
        want[host] = "block" if a / (a + c) - 1.28 * (a * c / ((a + c) ** 2 * (a + c + 1))) ** 0.5 > overall else "allow"
    judged = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), rules=()).collect()
    assert {r.host: r.verdict for r in judged} == want
    assert want["y.b.co.uk"] == want["x.b.co.uk"] == "block" and want["x.a.co.uk"] == want["x.c.org"] == "allow"


# 8


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_quality(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "#", "|", "\u00a0", "\x0b"]) for _ in range(rng.randrange(400))), "s") for i in range(400)]
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, " \n", "s"), (1003, "one two three four five six seven eight " * 5000, "s"), (1004, " ".join("word" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(60_000)), "s"), (7, rows[7][1], "s")]
    df = docs_of(spark, rows).withColumn("kept", F.lit("clash")).repartition(3)
    got = quality.judge(df).collect()
    texts = dict((i, t) for i, t, _ in rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id]), r.doc_id
        assert r.kept == (r.rejected_by is None) and not (r.kept and r.base_failed)
    assert next(r for r in got if r.doc_id == 1004).kept
    assert quality.judge(df.limit(0)).count() == 0


def test_order_follows_rejections_per_cost():
    import time

    def slow(f, rows):
        time.sleep(0.002)
        return rows % 2 == 0

    rules = {"never": lambda f, rows: rows < 0, "slow": slow, "quick": lambda f, rows: rows % 2 == 1}
    plan = quality.Plan(rules)
    for chunk in tokens.chunks(pa.array([" ".join(f"w{i}x{j}" for j in range(30)) for i in range(64)])):
        why = plan.reasons(quality.Facts(chunk), np.arange(64) < 8)
    assert plan.order() == ["quick", "slow", "never"]
    assert list(why) == ["slow", "quick"] * 32


def test_word_groups():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(60))) for _ in range(50)]
    for chunk in tokens.chunks(pa.array(texts)):
        rows = np.array([3, 7, 8, 20, 49])
        distinct, top = quality.Facts(chunk).word_groups(rows)
        words = [texts[i].split() for i in rows]
        assert distinct.tolist() == [len(set(w)) for w in words]
        assert top.tolist() == [max((w.count(x) for x in set(w)), default=0) for w in words]


def test_order_of_rules_does_not_change_verdicts(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = sorted((r.doc_id, r.kept) for r in quality.judge(df).collect())
    monkeypatch.setattr(quality.Plan, "order", lambda plan: sorted(plan.rules, reverse=True))
    assert sorted((r.doc_id, r.kept) for r in quality.judge(df).collect()) == one


# tokens


def test_tokens_match_regex():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB é\t\n\x0b\x1f\u3000xyz") for _ in range(rng.randrange(30))) for _ in range(500)] + [None, "", "A" * 5000]
    seen = {}
    for size in (1, 64, 1 << 20):
        out = []
        for chunk in tokens.chunks(pa.array(texts).slice(0), lower=True, size=size):
            starts, ends, first = chunk.words()
            hashes = chunk.hashes(starts, ends)
            for a, b in zip(first, first[1:], strict=False):
                out.append([(chunk.data[s:e].tobytes(), int(h)) for s, e, h in zip(starts[a:b], ends[a:b], hashes[a:b], strict=True)])
        words = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")] for t in texts]
        assert [[w.decode() for w, _ in row] for row in out] == words
        for row in out:
            for w, h in row:
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert list(tokens.chunks(pa.array([], pa.string()))) == []
    assert np.array_equal(np.diff(tokens.shingle_hashes(np.arange(12, dtype=np.uint64), np.array([0, 0, 3, 12]), 5)[1]), [0, 1, 5])


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [64, 256, 1024, 2048, 4096])
def test_constructed_texts_do_not_collide(spark, n):
    """Strings that agree under polynomials modulo a power of two: as lines, and as words of windows."""
    one, two = thue_morse(n), thue_morse(n, "b", "a")
    words = " ".join(f"w{i}" for i in range(7))
    texts = [f"{one}\n{two}", f"{one}\n{two}\n{one}", f"{one} {words} {two} {words} {one}", f"{words} {one} x {words} {one}"]
    for r in quality.judge(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(texts[r.doc_id])
    chunk = next(tokens.chunks(pa.array([f"{one} {two}"])))
    starts, ends, _ = chunk.words()
    a, b = chunk.hashes(starts, ends)
    assert a != b
