import itertools

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare

from tidewell.llm import packing
from tidewell.llm.workspace import documents


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 50), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_boundaries_are_optimal(histogram, buckets):
    bounds, counts = np.array(sorted(histogram)), np.array([histogram[b] for b in sorted(histogram)])

    def cost(tops):
        return sum(c * min(t for t in tops if t >= b) for b, c in histogram.items())

    every = [[*c, int(bounds[-1])] for k in range(buckets) for c in itertools.combinations(bounds[:-1].tolist(), k)]
    tops = packing.boundaries(bounds, counts, buckets)
    assert len(tops) <= buckets and cost(tops) == min(map(cost, every))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(500, 5000), st.integers(1, 9), min_size=2, max_size=40), st.integers(1, 6))
def test_boundaries_of_long_texts(histogram, buckets):
    """The least padded total by the plain program, beyond 511 words."""
    bounds = sorted(histogram)
    best = {(0, 0): 0}
    for level in range(1, buckets + 1):
        for j in range(1, len(bounds) + 1):
            found = [best[level - 1, i] + bounds[j - 1] * sum(histogram[b] for b in bounds[i:j]) for i in range(j) if (level - 1, i) in best]
            if found:
                best[level, j] = min(found)
    tops = packing.boundaries(np.array(bounds), np.array([histogram[b] for b in bounds]), buckets)
    assert sum(c * min(t for t in tops if t >= b) for b, c in histogram.items()) == min(best[k, len(bounds)] for k in range(1, buckets + 1) if (k, len(bounds)) in best)


def test_as_sql(spark):
    assert compare(spark, lambda s, d: packing.pack(documents(s, d)), packing.ORACLE_SQL, "/root/testdata/sf0.01") == 1000


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 6), (None, "a b", 7), (3, "a b c", 8), (3, "a b c", 8), (4, "x " * 40_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = packing.pack(df, budget=8).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 0), (2, 0), (3, 3), (3, 3), (4, 40_000)]
    assert len({(r.batch_id, r.slot) for r in got}) == len(got)
    used = {}
    for r in got:
        assert r.n_tokens <= r.bucket_len
        used[r.batch_id] = used.get(r.batch_id, 0) + r.bucket_len
    assert sorted(used) == list(range(len(used)))
    sizes = {}
    for r in got:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    assert all(total <= 8 or sizes[b] == 1 for b, total in used.items())
    assert packing.pack(df.limit(0)).collect() == []
