import random
import hashlib

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from tidewell.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(5)
    alphabet = "abcdeé ñ\n\t 漢字🚀.,!?0123 the ing"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    return ["", " ", "<|endoftext|>", "a" * 3000, "ab" * 900, "thethethe" * 150, "\r\n  x", *made]


def test_as_the_library(library):
    enc = bpe.Encoder(PATH, P.PATTERN)
    for text, parts in zip(texts(), enc.pieces(texts()), strict=True):
        ids = [int(i) for p in parts for i in p[0].split(",")]
        assert ids == library.encode_ordinary(text)
        assert b"".join(p[1] for p in parts) == text.encode()


def test_long_pieces_merge_alike():
    codec = bpe.Codec(bpe.load_ranks(PATH))
    rng = random.Random(1)
    for n in (2, 3, 17, 200, 900):
        piece = bytes(rng.choice(b"abcdehinot") for _ in range(n))
        if piece not in codec.ranks:
            assert codec._one(piece) == codec.encode([piece])[0]


def test_query(spark, library):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (4, "x " * 5000), (4, "x " * 5000)]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.digest_texts(df, PATH, P.PATTERN).collect()))
    want = []
    for k, text in rows:
        ids = library.encode_ordinary(text or "")
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)
    full = {r.doc_id: r for r in bpe.encode_texts(df, PATH, P.PATTERN).collect()}
    assert full[1].ids == library.encode_ordinary("Hello wörld") and bytes(full[1].decoded) == "Hello wörld".encode()
    assert bpe.digest_texts(df.limit(0), PATH, P.PATTERN).collect() == []
