import random
import re
from math import comb

import numpy as np
import pytest
from oracle import compare

from tidewell.llm import nearcopies, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = []
    for _, t in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i : i + 4]) for i in range(len(words) - 3)} or ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    found = [(k, len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))]
    return sorted(((k, n, c, k == c) for k, n, c in found), key=repr)


def make(seed, n, lengths):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdEé") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(30)]
    texts = [None, "", " \n", "a", "A", "a b c", "a b c d", "a b c d e", "x " * 50, "1 2 3 4 5 6 7", "1 2 3 4 5 6 7 8"]
    while len(texts) < n:
        base = [word() for _ in range(rng.choice(lengths))]
        if rng.random() < 0.4:
            base += passage
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                at = rng.randrange(len(copy) + 1)
                copy[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            texts.append(" ".join(copy))
    rows = [(n * 7 % 1009, t) for n, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (rows[21][0], rows[22][1]), (None, rows[23][1]), (None, "alone it is"), (None, None)]


def result(df, **names):
    return sorted(map(tuple, nearcopies.dedup(df, **names).collect()), key=repr)


@pytest.mark.parametrize("block", [1024, 4])
def test_brute_force(spark, monkeypatch, block):
    """With one block for each component, and with several that are dealt anew and met by each other."""
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rows = make(3, 220, [6, 20, 60, 150])
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class", "2 as `row`", "3 as `a.b`", "4 as node")
    assert nearcopies.dedup(df).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result(df) == brute(rows)


def test_chain_over_blocks(spark, monkeypatch):
    """Each text is similar to the next only, so that blocks must meet."""
    monkeypatch.setattr(nearcopies, "BLOCK", 3)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[k * 6 : k * 6 + 80])) for k in range(40)]
    want = brute(rows)
    assert {c for _, _, c, _ in want} == {0}
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_links_of_a_block_are_stars():
    """What a block joins is a chain of texts here; its classes are told their root at once, without rounds over the links."""
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[k * 6 : k * 6 + 80]).encode() for k in range(9)]
    sets = nearcopies.exact_sets(texts, nearcopies.SHINGLE)
    signatures = np.stack([nearcopies.signature(s).astype("<u2") for s in nearcopies.shingle_sets(texts, nearcopies.SHINGLE)])
    assert sorted(nearcopies._links(list(range(20, 29)), [[1]] * 9, None, signatures, sets)) == [(k, 20) for k in range(21, 29)]


@pytest.mark.parametrize("block, most", [(1024, 1), (3, 3)])
def test_rounds_over_links(spark, monkeypatch, block, most):
    """Rounds for the coarse components, and only where these have several blocks for what the blocks leave apart."""
    names, whole = [], nearcopies.components
    monkeypatch.setattr(nearcopies, "components", lambda links, ws, name: (names.append(name), whole(links, ws, name))[1])
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[k * 6 : k * 6 + 80])) for k in range(40)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert names[0] == "coarse" and len(names) <= most


def test_group_of_thousands(spark):
    rng = random.Random(5)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(k, " ".join(base[: 40 + k % 60] + [f"n{k}"] + base[41 + k % 60 :])) for k in range(3000)] + [(9000 + k, "same text of a thousand " * 3) for k in range(1000)]
    got = {r.doc_id: r.component_id for r in nearcopies.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 0 if k < 9000 else 9000 for k, _ in rows}


def test_odd_tables(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string")) == []
    rows = [(1, "ab " * 700_000 + "c"), (2, "ab " * 700_000 + "c"), (3, "x" * 2_000_000)]
    assert result(spark.createDataFrame(rows, "`k.1` long, `t.1` string"), key="k.1", text="t.1") == brute(rows)
    assert result(spark.createDataFrame([(str(k), t) for k, t in rows], "doc_id string, text string")) == brute([(str(k), t) for k, t in rows])


def test_values_are_equal_as_often_as_sets_are_similar():
    rng = np.random.default_rng(2)
    for n in (10, 100, 1000):
        equal = []
        for _ in range(60):
            both = rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64)
            one, two = np.unique(both[: n * 9 // 10]), np.unique(both[n // 10 :])
            equal.append((nearcopies.signature(one) == nearcopies.signature(two)).mean())
        assert abs(np.mean(equal) - 0.8) < 0.03


def test_recall_at_the_threshold():
    """Pairs of a similarity of just 0.8: by a shared key, and by the batches."""
    rng = np.random.default_rng(4)
    lost = 0
    for n in (10, 20, 50, 300):
        for _ in range(400):
            both = np.unique(rng.integers(0, 2**63, n, dtype=np.int64)).view(np.uint64)
            x, y = (nearcopies.signature(s) for s in (both[: n * 9 // 10], both[n // 10 :]))
            a, _ = nearcopies.survivors(np.stack([x, y]).astype(np.uint16), np.array([0]), np.array([1]))
            lost += not len(a) or not (x == y).reshape(nearcopies.BANDS, nearcopies.ROWS).all(axis=1).any()
    assert lost == 0


def test_bounds():
    """The least count is the first whose posterior is not below the miss probability."""
    for n, least in nearcopies.CHECKS:
        # P(similarity >= 0.8) by integrating the posterior
        t = np.linspace(0, 1, 200_001)
        for m, keeps in ((least - 1, False), (least, True)):
            density = t**m * (1 - t) ** (n - m)
            assert (density[t >= 0.8].sum() / density.sum() >= nearcopies.MISS) == keeps
    assert comb(4, 2) == 6 and nearcopies.CHECKS[-1][0] == nearcopies.VALUES


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_as_sql(spark, sf):
    assert compare(spark, queries.op12_nearcopies, nearcopies.ORACLE_SQL, f"/root/testdata/sf{sf}") > 0
