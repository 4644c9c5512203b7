import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import nearest


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        mine = x[ids.index(q)]
        scores = sorted(((-float((x[i] * mine).sum()), ids[i]) for i in range(len(ids)) if ids[i] != q))
        out[q] = [(-s, i) for s, i in scores[:k]]
    return out


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = nearest.search(df, F.col("id") % 20 == 0).collect()
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(by[r.query_id])
        assert abs(r.score - float((x[ids.index(r.query_id)] * x[ids.index(r.vec_id)]).sum())) < 1e-12
    assert by.keys() == want.keys() and all(len(v) == 20 for v in by.values())
    recall = np.mean([len({i for _, i in by[q]} & {i for _, i in want[q]}) / 20 for q in want])
    assert recall >= 0.9, recall


def test_odd_rows(spark):
    one = [1.0, 0.0, 2.0, 0.5, 1.0]
    rows = [(0, one), (20, one), (40, [0.0] * 5), (60, None), (80, [1.0, None, 1.0, 1.0, 1.0]), (100, [float("nan")] * 5), (None, one), (3, one), (2, one), (2, one), (7, [1.0])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in nearest.search(df, F.col("id") % 20 == 0, k=3).collect())
    assert got == [(0, 1, 2, 6.25), (0, 2, 2, 6.25), (0, 3, 3, 6.25), (20, 1, 0, 6.25), (20, 2, 2, 6.25), (20, 3, 2, 6.25)]
    assert nearest.search(df.limit(0), F.col("id") % 20 == 0).collect() == []


def test_repeated_ids_are_all_candidates(spark):
    rng = np.random.default_rng(3)
    ids = [int(i) for i in rng.integers(0, 60, 300)] + [40] * 150  # one id with a third of all rows
    x = np.round(rng.normal(size=(450, 8)), 2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "`vec.id` long, `the ``v` array<double>")
    got = sorted(tuple(r) for r in nearest.search(df, F.col("id") % 20 == 0, k=5, key="vec.id", vector="the `v", probes=4096).collect())
    want = []
    for n, q in enumerate(ids):
        if q % 20 == 0:
            best = sorted((-float((x[m] * x[n]).sum()), ids[m]) for m in range(len(ids)) if m != n)[:5]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_hot_vector_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 50)
    monkeypatch.setattr(nearest, "QUERIES", 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8)).astype(np.float32).astype(float)
    x[::3] = 3 * x[0]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(nearest.search(df, F.col("id") % 20 == 0, k=10, probes=4096).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {q: [i for _, i in v] for q, v in brute(list(range(600)), x, range(0, 600, 20), 10).items()}
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    assert got[0] == want[0]
