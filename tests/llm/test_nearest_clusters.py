import numpy as np
from pyspark.sql import functions as F
from test_nearest import brute

from tidewell.llm import nearest


def test_ids_that_follow_clusters(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 16))
    x[:600] = x[0] + 0.01 * rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.search(df, F.col("id") % 60 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(list(range(6000)), x, range(600, 6000, 60), 20)
    recall = np.mean([len(got[q] & {i for _, i in v}) / 20 for q, v in want.items()])
    assert recall >= 0.9, recall
