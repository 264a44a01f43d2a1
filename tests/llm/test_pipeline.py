import hashlib
import re
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

import corpus_pipeline
from lakescribe.llm import bpe, toxicity

from .test_near_dedup import brute as near_brute

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, scores):
    """What run() returns, for rows (doc_id, text, source) and a toxicity score by doc_id."""
    docs = [d for d in docs if scores[d[0]] < 0.3]
    best = {}
    for i, text, _ in docs:
        key = "".join(WORD.findall(text or ""))
        best[key] = min(best.get(key, (1, 0)), (-len(text or ""), i))
    docs = [d for d in docs if best["".join(WORD.findall(d[1] or ""))][1] == d[0]]
    near = near_brute([d[:2] for d in docs])
    docs = [d for d in docs if near[d[0]][2]]
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(sizes), sum(sizes.values())
    while True:
        level = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * level > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: weights[s] * level for s in open_}
    out = Counter()
    for i, text, source in docs:
        rate = target[source] / sizes[source] if sizes[source] else 0
        u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:8], 16) / 2**32
        out[i, text or ""] += int(rate) + (u < rate - int(rate))
    return out


def test_run_matches_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    machine = toxicity.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.with_score(table, machine).select("doc_id", "score").collect()}
    want = brute([(r.doc_id, r.text, r.source) for r in table.collect()], scores)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = Counter()
    for (i, text), n in want.items():
        ids = library.encode_ordinary(text)
        rows[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += n
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == +rows


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
