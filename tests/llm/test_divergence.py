import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare

from tidewell.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(rows, least_docs=3, leading=200):
    """In Python's own integers."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(lower(text or ""))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        share = lambda have: {t: 1 + 10**9 * (have[t] + 1) // (sum(have[x] for x in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        usual = share(sum((counts[lang, s] for s in sources), Counter()))
        shares = {s: share(counts[lang, s]) for s in sources}
        for s, p in shares.items():
            pairs = [(-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), o.encode()) for o, q in shares.items() if o != s]
            terms = [(-((p[t] - usual[t]) ** 2 // usual[t]), t.encode()) for t in kept if counts[lang, s][t] and p[t] > usual[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:leading])):
                out += [(lang, s, part, item.decode(), -value, n) for n, (value, item) in enumerate(found, 1)]
    return sorted(out)


def make(seed=1, n=150):
    rng = random.Random(seed)
    words = ["A", "b", "Ärger", "ärger", "été", "the", "The", "x1y", "naïve", "日本語", "a_b", "it's", "🙂", "zz" * 300] + [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(9) for j in range(9)]
    rows = [(None, None, None), ("", "", ""), ("123 --", "en", "digits"), (None, "en", "none"), ("one two three", "lonely", "s"), ("four", "lonely", None), ("only", "single", "s")]
    for _ in range(n):
        weights = [1 / (1 + (k * 7 + rng.randrange(3)) % 31) for k in range(len(words))]
        text = rng.choice(" \n,.;") .join(rng.choices(words, weights, k=rng.randrange(0, 60)))
        rows.append((text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", "Z", None])))
    return rows + rows[7:12] * 3


def test_brute_force(spark, monkeypatch):
    rows = make()
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 as term", "2 as `n`", "3 as `a.b`", "4 as bucket")
    want = brute(rows)
    assert sorted(map(tuple, divergence.audit(df).collect())) == want
    # several buckets, stripes and leading terms of a bucket
    monkeypatch.setattr(divergence, "CELLS", 40)
    monkeypatch.setattr(divergence, "STRIPE", 2)
    assert sorted(map(tuple, divergence.audit(df).collect())) == want
    got = divergence.audit(df, leading=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == brute(rows, leading=5)


def test_empty_table_and_long_text(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
    rows = [("ab cd " * 400_000 + "e" * 100_000, "l", "a"), ("ab", "l", "b"), ("AB cd ef", "l", "b"), ("ab", "l", "b")]
    df = spark.createDataFrame(rows, "`t.1` string, `l.1` string, `s.1` string")
    assert sorted(map(tuple, divergence.audit(df, "t.1", "l.1", "s.1").collect())) == brute(rows)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="aAbé1 _日", max_size=12), max_size=8))
def test_colliding_hashes(texts):
    """Equal results by a good hash, a poor one and one that is always the same."""
    for hash_of in (divergence.xxhash.xxh3_64_intdigest, lambda b: len(b) % 2, lambda b: 7):
        terms, term, doc = divergence.terms_of([t.encode() for t in texts], hash_of)
        assert len(set(terms)) == len(terms)
        found = [[] for _ in texts]
        for k, d in zip(term, doc):
            found[d].append(terms[k].decode())
        assert found == [TERM.findall(lower(t)) for t in texts]


def test_shares_and_sums():
    assert divergence.share(np.array([0, 9 * 10**14]), 9 * 10**14, 5).tolist() == [1 + 10**9 // (9 * 10**14 + 5), 1 + 10**9 * (9 * 10**14 + 1) // (9 * 10**14 + 5)]
    rng = np.random.default_rng(3)
    dense = rng.integers(2, 10**9, (6, 40)) * (rng.random((6, 40)) < 0.3)
    dense[4] = 0
    absent = rng.integers(1, 50, 6)
    cells = [np.flatnonzero(r) for r in dense]
    indptr, cols = np.cumsum([0, *map(len, cells)]), np.concatenate(cells)
    full = np.where(dense > 0, dense, absent[:, None])
    for a in range(6):
        got = divergence.against_all(a, indptr, cols, dense[dense > 0], absent, 40)
        assert got.tolist() == [sum((int(p) - int(q)) ** 2 // int(q) for p, q in zip(full[a], full[b])) for b in range(6)]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_as_sql(spark, sf):
    assert compare(spark, queries.op13_divergence, divergence.ORACLE_SQL, f"/root/testdata/sf{sf}") > 1000
