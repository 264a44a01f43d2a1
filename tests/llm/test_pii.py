import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakescribe.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    """The base by its definition, as kind:start:end."""
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def spelled(spans):
    return [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans]


def test_base_matches_definition():
    rng = random.Random(4)
    pieces = ["a", "B.", "@", ".", "-", "+", " ", "%", "1", "22", "255", "256", "0", "é", "😀", "(", ")", "x@y.z", "1.2.3.4", "4539578763621486", "4539 5787 6362 1486", "+1 (766) 555-3022", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        assert spelled(pii.base_spans(text)) == brute(text), text
    for text in ("1" * 20_000, "a" * 20_000 + "@b", "+1" + " " * 20_000, "a@b.c%d@e.f", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "@" * 5000):
        assert spelled(pii.base_spans(text)) == brute(text)


def test_windows_cover_anchors():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab c") if rng.random() < 0.97 else rng.choice("1@") for _ in range(rng.randrange(0, 2000)))
        starts = pii.windows(text)
        assert starts == sorted(set(starts))
        for i, c in enumerate(text):
            if c in "1@":
                near = range(max(0, i - pii.REACH), min(len(text), i + pii.REACH))
                assert all(any(s <= j < s + pii.WINDOW for s in starts) for j in near)


@pytest.fixture(scope="module")
def corpus(spark):
    return [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]


def test_network_learns_respelt_spans(corpus):
    stretches = [t[max(0, m.start() - 150) : m.end() + 150] for t in corpus for m in list(re.finditer("[0-9@]", t))[:1]]
    codes, wanted = pii.examples(stretches[: len(stretches) * 2 // 3])
    network = pii.Network()
    network.train(codes, wanted)
    rng = random.Random(8)
    hits, total, false = 0, 0, 0
    for text in stretches[len(stretches) * 2 // 3 :]:
        base = pii.base_spans(text)
        false += len(pii.added_spans([text], [base], network)[0])
        for kind, a, b in base[:1]:
            other = text[:a] + (own := pii._respelt(kind, text[a:b], rng)) + text[b:]
            mine = pii.base_spans(other)
            found = mine + pii.added_spans([other], [mine], network)[0]
            total += 1
            hits += any(s[1] < a + len(own) and s[2] > a for s in found)
    assert total > 10 and hits > 0.85 * total and false <= 0.02 * len(stretches)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "mail a.b@c.de now"), (3, "mail a.b@c.de now"), (4, "x " * 30_000 + "é 10.0.0.1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = sorted((r.doc_id, [f"{s.kind}:{s.start}:{s.end}" for s in r.spans]) for r in pii.find(docs, None).collect())
    assert got == sorted((i, brute(t or "")) for i, t in rows)
    assert pii.train(docs.limit(0)) is None
    assert pii.find(docs.limit(0), None).count() == 0
    assert pii.train(docs.filter("doc_id < 3")) is None


def test_query_base_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in want) for k in pii.KINDS)
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_marginals_sum_to_one():
    network = pii.Network()
    probable, _ = network.marginals(network.emissions(np.stack([pii.symbols("a@b.cd 1.2.3.4", 32)]))[0])
    assert probable.sum(2) == pytest.approx(np.ones(probable.shape[:2]), abs=1e-3)


@pytest.fixture(scope="module")
def trained(corpus):
    stretches = [t[max(0, m.start() - 150) : m.end() + 150] for t in corpus for m in list(re.finditer("[0-9@]", t))[:1]] + [t[:220] for t in corpus[:2000]]
    network = pii.Network()
    codes, wanted = pii.examples(stretches)
    pick = np.random.default_rng(2).permutation(len(codes))[: pii.TRAIN_WINDOWS]
    network.train(codes[pick], wanted[pick])
    return network


def test_whole_texts_are_read(trained):
    """An address without digits and "@" is found anywhere in a text, in ASCII and other prose."""
    for prose in ("the plain words go on ", "die Wörter gehen weiter "):
        for n in (0, 7, 40):
            text = prose * n + "write to anna.berg(at)example.com for help, " + prose * n
            at = text.index("anna")
            assert not re.search("[0-9@]", text)
            found = pii.added_spans([text], [[]], trained)[0]
            assert any(kind == 0 and a < at + 24 and b > at for kind, a, b in found), (n, found)
    for n in range(600):
        starts = pii.windows("x" * n)
        assert all(any(s <= j < s + pii.WINDOW for s in starts) for j in range(n))
        assert all(any(s <= j and j + 48 <= s + pii.WINDOW for s in starts) for j in range(n - 47))


def test_spans_cut_by_every_window_are_joined(trained):
    class Marks:
        """Tags exactly the stretches of 'x'."""

        def decode(self, codes):
            return [[(0, m.start(), m.end(), 1.0) for m in re.finditer("x[^ ]*", bytes(c.astype(np.uint8)).decode())] for c in codes]

    for before in (0, 1, 47, 48, 100, 400):
        for length in (20, 47, 48, 49, 60, 95, 96, 97, 150, 700, 3000):
            own = "x" * length + "(at)" + "x" * length
            text = "a " * before + own + " b" * before
            found = pii.added_spans([text], [[]], Marks())[0]
            assert (0, 2 * before, 2 * before + len(own)) in found, (before, length, found)


def test_digits_of_other_scripts():
    arabic = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
    text = "call 766 555 3022 now"
    assert (pii.symbols(text, 32) == pii.symbols(text.translate(arabic), 32)).all()
    assert pii.plausible(3, "766 555 3022".translate(arabic)) and pii.plausible(1, "10:0:0:1".translate(arabic))
    assert pii.plausible(2, "4539.5787.6362.1486".translate(arabic))


def test_scores_are_the_emissions():
    network = pii.Network()
    codes = np.random.default_rng(3).integers(0, pii.SYMBOLS, (7, 50))
    assert np.allclose(network.states(codes) @ network.p["out"] + network.p["bias"], network.emissions(codes)[0], atol=1e-4)


def test_gradients_are_slopes():
    network = pii.Network()
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    rng = np.random.default_rng(0)
    codes, wanted = rng.integers(32, 127, (3, 10)), np.zeros((3, 10), int)
    wanted[0, 2], wanted[0, 3:6], wanted[1, 0], wanted[1, 1:3] = 3, 4, 1, 2

    def loss():
        scores, step = network.emissions(codes)[0], network.p["next"] + network.blocked
        sums = scores[0] + network.p["first"] + network.blocked[0]
        goal, each = wanted.T, np.arange(3)
        own = sums[each, goal[0]]
        for i in range(1, len(scores)):
            sums = np.log(np.exp(sums[:, :, None] + step).sum(1)) + scores[i]
            own = own + step[goal[i - 1], goal[i]] + scores[i][each, goal[i]]
        return (np.log(np.exp(sums).sum(1)) - own).mean()

    grads = network.gradients(codes, wanted)
    for name, values in network.p.items():
        flat, got = values.ravel(), np.asarray(grads[name]).ravel()
        for at in np.argsort(-abs(got))[:3]:
            old = flat[at]
            flat[at] = old + 1e-3
            up = loss()
            flat[at] = old - 1e-3
            slope = (up - loss()) / 2e-3
            flat[at] = old
            assert got[at] == pytest.approx(slope, rel=0.02, abs=1e-4), name


def test_windows_without_a_path_of_gain_hold_no_span(trained, corpus):
    """The bound never closes a window whose best path has a span."""
    texts = [t for t in corpus if re.search("[0-9@]", t)][:60]
    codes = np.stack([pii.symbols(t[s : s + pii.WINDOW], pii.WINDOW) for t in texts for s in pii.windows(t)[:20]])
    free = pii.Network()
    free.p, free._open = trained.p, lambda states: np.arange(states.shape[1])
    assert len(trained._open(trained.states(codes))) < 0.6 * len(codes)
    assert [[s[:3] for s in w] for w in trained.decode(codes)] == [[s[:3] for s in w] for w in free.decode(codes)]


def test_first_pass_loses_nothing(trained, corpus):
    """Spans from the windows that the first pass picks are those of reading every window."""
    rng = random.Random(5)
    texts = [t for t in corpus if re.search("[0-9@]", t)][:40] + corpus[:40]
    for text in corpus[40:140]:
        gaps = [m.end() for m in re.finditer(r"\s", text)] or [0]
        at = rng.choice(gaps)
        own = rng.choice(["anna.berg(at)example.com", "tom [at] example dot org", "10 . 0 . 20 . 7", "4539.5787.6362.1486", "0766/555/3022", "one three five"])
        texts.append(f"{text[:at]}{own} {text[at:]}")
    base = [pii.base_spans(t) for t in texts]
    picked = pii.added_spans(texts, base, trained)
    assert picked == pii.added_spans(texts, base, trained, pii.windows)
    assert sum(map(len, picked)) > 40
    assert sum(len(pii.candidates(t)) for t in texts) < 0.5 * sum(len(pii.windows(t)) for t in texts)


def test_planted_spellings_without_base_spans(trained, corpus):
    """Recall and precision of what the network adds, on spellings put into prose without digits."""
    rng = random.Random(6)
    prose = [t for t in corpus if 300 < len(t) < 3000 and not re.search("[0-9@]", t)][:200]
    found = exact = elsewhere = 0
    for i, text in enumerate(prose):
        at = rng.choice([m.end() for m in re.finditer(r"\s", text)])
        own = [f"mia.{'abcdefgh'[i % 8]}olm(at)example.org", f"{i % 256} . 20 . 3 . {i % 9}", "4539/5787/6362/1486", f"1 (766) 555-{3000 + i}"][i % 4]
        planted = f"{text[:at]}{own} {text[at:]}"
        spans = pii.added_spans([planted], [pii.base_spans(planted)], trained)[0]
        hits = [(a, b) for _, a, b in spans if a < at + len(own) and b > at]
        found, exact, elsewhere = found + bool(hits), exact + ((at, at + len(own)) in hits), elsewhere + len(spans) - len(hits)
    assert found >= 0.85 * len(prose) and exact >= 0.7 * len(prose) and elsewhere <= 0.01 * len(prose), (found, exact, elsewhere)
