import hashlib
import random
import re
from collections import Counter

from oracle import compare

from tidewell.llm import substrings
from tidewell.llm.workspace import Workspace, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, width=35):
    every = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in every for i in range(len(w) - width + 1))
    out = []
    for w in every:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def make():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(n)) for n in (34, 35, 36, 60, 200)]
    texts = [None, "", " \t", "a " * 34, "b " * 35, "c " * 36, "d " * 500]
    for _ in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 80)))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            parts += [p, "\n".join(word() for _ in range(rng.randint(0, 50)))]
        texts.append(" ".join(parts))
    return texts + texts[7:30]


def test_as_brute_force(spark):
    texts = make()
    rows = [(n if n % 7 else n // 7, t, 0) for n, t in enumerate(texts)] + [(None, texts[9], 0), (None, texts[9], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc int")
    want = sorted((k is not None, k or 0, *b) for (k, _, _), b in zip(rows, brute([t for _, t, _ in rows])))
    for batches in (1, 3):
        got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(df, batches=batches).collect())
        assert got == want
    assert substrings.digest(df.limit(0)).collect() == []


def test_runs_are_compacted_and_matched(spark, monkeypatch):
    monkeypatch.setattr(substrings, "FAN_IN", 2)
    docs = substrings.keyed(spark.createDataFrame(list(enumerate(make())), "doc_id long, text string"))
    index = substrings.FingerprintIndex(Workspace(spark, "test"))
    parts = [substrings.fingerprints(docs.where(f"pmod(doc, 5) = {n}")) for n in range(5)]
    for p in parts[:4]:
        index.add(p)
    assert len(index.names) <= 2
    old = {r.hash for p in parts[:4] for r in p.collect()}
    assert {r.hash for r in index.runs().collect()} == old
    assert sorted(map(tuple, index.matches(parts[4]).collect())) == sorted(tuple(r) for r in parts[4].collect() if r.hash in old)


def test_runs_made_to_collide(spark):
    """Windows of two words in the order of a Thue-Morse word and its complement, and an unbroken megabyte."""
    texts = [" ".join("ab"[(n.bit_count() + k) & 1] * 3 for n in range(35)) for k in (0, 1)] + ["x" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.digest(df).collect()) == [(0, 35, 0), (1, 35, 0), (2, 1, 0)]


def test_as_sql(spark):
    assert compare(spark, lambda s, d: substrings.digest(documents(s, d)), substrings.ORACLE_SQL, "/root/testdata/sf0.01") == 1000
