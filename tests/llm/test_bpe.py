import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lakescribe.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_match_the_library(library):
    encoder = bpe.TextEncoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    rng = random.Random(1)
    texts = ["", " ", "a" * 5000, "ab" * 3000, "\n" * 700 + "x", "été" * 800, "<|endoftext|>", "日本語のテキスト" * 50, "0123456789" * 400, "don't we'll x"]
    for _ in range(1500):
        alphabet = rng.choice(["ab", "thean ", "étèan", "01 .", "a \n", "aéb .\n\u00a0", "#*- \n", "".join(map(chr, range(32, 1200, 7)))])
        texts.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 300))))
    for text in texts:
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert encoder.tree.decode(ids) == text.encode()
    tokens, offsets = bpe.TextEncoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN).encode_all(texts)
    assert [tokens[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == list(map(library.encode_ordinary, texts))
    data, cuts = encoder.tree.decode_all(tokens, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:], strict=False)] == texts


def test_joins_are_the_way_of_most_pieces(library):
    """Every piece that is no token itself goes through joins; windows stay small."""
    tree = bpe.TreeEncoder(bpe.load_ranks(PATH))
    rng = random.Random(3)
    pieces = ["".join(rng.choice("etaoinshrdlué") for _ in range(rng.randrange(2, 40))).encode() for _ in range(4000)]
    tokens, offsets = tree.encode_all(pieces)
    for piece, a, b in zip(pieces, offsets, offsets[1:], strict=False):
        assert tokens[a:b].tolist() == library._encode_single_piece(piece), piece
    split = [p for p in pieces if p not in tree.ranks]
    assert tree.seams == sum(len(p) - 1 for p in split)  # a tree over bytes has one join less than leaves
    assert tree.stable_seams > 0.1 * tree.seams and tree.grown < tree.seams


def test_memories_may_be_lost(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    encoder = bpe.TextEncoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    for text in ("some words here", "and other words here again", "thaner mentle évioi lentim", "some words here"):
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_long_pieces(library):
    """Pieces of 200,000 to 1,000,000 bytes, and a text in many slices."""
    encoder = bpe.TextEncoder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    rng = random.Random(9)
    for text in ("".join(rng.choice("abcdeé") for _ in range(200_000)), "ab" * 100_000, "lorem ipsum, 12 \n" * 300_000):
        assert encoder.encode(text) == library.encode_ordinary(text)
    ids = encoder.encode("a" * 1_000_000)
    assert encoder.tree.decode(ids) == b"a" * 1_000_000


def test_every_token_encodes_to_itself():
    tree = bpe.TreeEncoder(bpe.load_ranks(PATH))
    bare = dict(tree.ranks)
    for token, rank in list(tree.ranks.items()):
        if 1 < len(token) <= 40:
            del bare[token]
            other = bpe.TreeEncoder.__new__(bpe.TreeEncoder)
            other.ranks = bare
            merged = other.merge(token)
            bare[token] = rank
            pair = [tree.bytes_of[i] for i in merged]
            assert len(pair) == 2 and max(merged) < rank  # the last merge makes the token


def test_documents_round_trip(spark, library):
    rows = [(1, "Hello  wörld\n"), (2, None), (3, ""), (3, ""), (4, "x" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    out = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN)
    got = sorted((r.doc_id, list(r.tokens)) for r in out.collect())
    assert got == sorted((i, library.encode_ordinary(t or "")) for i, t in rows)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode_documents(out, PATH).collect()}
    assert back == {i: (t or "").encode() for i, t in rows}
    assert bpe.encode_documents(docs.limit(0), PATH, public_tokenizers.PATTERN, decoded=True).count() == 0


def test_query_matches_the_library(spark, library):
    import hashlib

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
