import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare

from tidewell.llm import setjoin
from tidewell.llm.components import components
from tidewell.llm.workspace import Workspace, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = []
    for _, t in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets)))


def make(seed, n, lengths):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdEé") for _ in range(rng.randint(1, 5)))
    passage = " ".join(word() for _ in range(30))
    texts = [None, "", "a", "A", "a b c", "a b c d", "a b c d e", "x " * 50]
    while len(texts) < n:
        base = [word() for _ in range(rng.choice(lengths))]
        if rng.random() < 0.4:
            base += passage.split()
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 18))):
                at = rng.randrange(len(copy) + 1)
                copy[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            texts.append(" ".join(copy))
    return list(enumerate(texts))


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 5)
    rows = make(3, 200, [60, 100, 150])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in setjoin.join(df).collect()) == brute(rows)


def test_as_brute_force(spark):
    for seed, lengths in ((1, [3, 5, 7, 9, 12, 20, 30]), (2, [40, 90, 130, 200, 400])):
        rows = make(seed, 250, lengths)
        rows += [rows[20], (10_000, rows[20][1])]
        df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, doc int")
        assert sorted(tuple(r) for r in setjoin.join(df).collect()) == brute(rows)
    assert setjoin.join(df.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32), st.data())
def test_no_similar_pair_escapes(size, seed, data):
    """Of two similar sets' segments in a scheme, fewer than the larger must allot differ."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**64, size, dtype=np.uint64)
    drop = data.draw(st.integers(0, size // 3))
    b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**64, data.draw(st.integers(0, size // 3)), dtype=np.uint64)]))
    a = np.unique(a)
    both = len(np.intersect1d(a, b))
    if not len(b) or 100 * both < 75 * (len(a) + len(b) - both):
        return
    small, large = sorted((a, b), key=len)
    schemes = setjoin.Schemes()
    own = schemes.of(len(small))
    need = dict(schemes.below(len(large)))[own] + 1
    few = schemes.bands[own][1] <= setjoin.SMALL
    indexed, _, _ = setjoin.entries(small, own, schemes.segments(own), few)
    looked, places, count = setjoin.entries(large, own, schemes.segments(own), few)
    shared = np.isin(looked, indexed)
    if few:
        free = 2 * (count - len(np.unique(places[shared])))
    else:
        free = int((~shared).sum())
        assert count >= need
    assert free < need


def test_components(spark):
    ws = Workspace(spark, "test")
    chain = [(i + 1, i) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long"), ws, "c").collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == got[101] == got[102] == 100
    assert components(spark.createDataFrame([], "a long, b long"), ws, "e").collect() == []


def test_too_few_segments(spark, monkeypatch):
    """With fewer segments than are needed, large sets are compared with all others."""
    monkeypatch.setattr(setjoin, "SLACK", 0.5)
    monkeypatch.setattr(setjoin, "FEW", 20)
    rows = make(5, 60, [150, 200])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in setjoin.join(df).collect()) == brute(rows)


def test_words_made_to_collide(spark):
    """Thue-Morse words and their complements have one polynomial hash modulo 2**64, whatever the base."""
    rows = []
    for size in (1024, 2048, 4096):
        word = "".join("ab"[n.bit_count() & 1] for n in range(size))
        rows += [(len(rows), word), (len(rows) + 1, word.translate(str.maketrans("ab", "ba")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.component_id for r in setjoin.join(df).collect()) == list(range(6))


def test_as_sql(spark):
    assert compare(spark, lambda s, d: setjoin.join(documents(s, d)), setjoin.ORACLE_SQL, "/root/testdata/sf0.01") == 1000


def test_similar_sets_are_not_parted():
    """Members of a group that can be similar stay in one part, others mostly do not; many near copies are one part."""
    rng = np.random.default_rng(11)
    sets = []
    for size in (1, 2, 4, 7, 30, 60, 250, 600):
        for _ in range(12):
            base = rng.integers(0, 2**64, size, dtype=np.uint64)
            sets.append(np.unique(base))
            for _ in range(3):
                drop = rng.integers(0, size // 5 + 1)
                sets.append(np.unique(np.concatenate([base[drop:], rng.integers(0, 2**64, rng.integers(0, size // 6 + 1), dtype=np.uint64)])))
    probes = rng.random(len(sets)) < 0.5
    part = setjoin._parts(np.array([len(x) for x in sets]), setjoin.folded([setjoin.sketch(x) for x in sets]), probes)
    for i in range(len(sets)):
        for j in range(i):
            if (probes[i] or probes[j]) and setjoin._linked(sets[i], sets[j]):
                assert part[i] == part[j] >= 0
    assert len(set(part.tolist())) > 60
    alone = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
    close = [np.append(alone, np.uint64(n)) for n in range(3000)]
    part = setjoin._parts(np.array([len(x) for x in close]), setjoin.folded([setjoin.sketch(x) for x in close]), np.ones(len(close), bool))
    assert set(part.tolist()) == {0}


def test_unlike_texts_do_not_meet_block_by_block(spark, monkeypatch):
    """Small sets that share segments by chance alone, in a component of several blocks: no text is shipped once for each other block."""
    monkeypatch.setattr(setjoin, "BLOCK", 5)
    rng = random.Random(12)
    rows = [(n, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(6, 11)))) for n in range(300)]
    rows += [(300 + n, rows[n][1] + " more") for n in range(0, 300, 10)]
    made = {}
    put = Workspace.put

    def noted(self, df, name):
        out = put(self, df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(Workspace, "put", noted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in setjoin.join(df).collect()) == brute(rows)
    assert made["coarse"] > 100 and made["across"] <= len(rows), made
