import re
from collections import Counter

import numpy as np

from tidewell.llm import quality
from tidewell.llm.workspace import documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


TEXTS = [None, "", " \n\t", "a b", "a b c", "a b c a b c", "x " * 400, "é🚀|<>\nab\nab\n\nab\r\nab", "one\x0btwo\x0cthree four five", " ".join(str(i % 97) for i in range(5000)), " ".join(map(str, range(300)))]


def test_statistics(spark):
    rows = [(n, t) for n, t in enumerate(TEXTS)] + [(5, TEXTS[5]), (None, "a a a a a a")]
    df = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, words int")
    got = sorted((r.doc_id is not None, r.doc_id or 0, *[r[c] for c in quality.BASE], r.base_failed) for r in quality.judge(df, []).collect())
    assert got == sorted((k is not None, k or 0, *brute(t)) for k, t in rows)
    assert quality.judge(df.limit(0), []).collect() == []
    assert quality.accepted(df, []).columns == df.columns


def test_whole_table(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = quality.fit(docs, labels)
    assert rules and rules == quality.fit(docs.repartition(5), labels)
    got = {r.doc_id: r for r in quality.judge(docs, rules).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        g = got[r.doc_id]
        assert (*[g[c] for c in quality.BASE], g.base_failed) == brute(r.text)
        assert not (g.base_failed and g.kept)
    rated = [(r.quality, got[r.doc_id]) for r in labels.collect()]
    rejected = [q for q, g in rated if not g.base_failed and not g.kept]
    assert sum(q == 0 for q in rejected) >= 0.95 * len(rejected)
    assert sum(g.kept for q, g in rated if q == 0) <= 0.2 * sum(q == 0 for q, _ in rated)
    assert quality.accepted(docs, rules).count() == sum(g.kept for g in got.values())


def test_learning():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.5)) | (x["c"] > 0.95)
    rules = quality.learn(x, bad, np.arange(3000) % 3 == 0)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= quality._covers(r, x, 3000)
    assert (hit == bad).mean() > 0.98
    assert quality.learn(x, np.zeros(3000, bool), np.arange(3000) % 3 == 0) == []


def test_no_labels(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    assert quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int")) == []
    assert quality.fit(docs, spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1)], "doc_id long, quality int")) == []
