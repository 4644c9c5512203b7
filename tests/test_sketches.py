import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import sketches
from tidewell.sources.scratch import stored

SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


def exact(rows, share):
    """The least value up to which there is the share of the weight."""
    total, sofar = sum(w for _, w in rows), 0
    for x, w in sorted(rows):
        sofar += w
        if sofar >= share * total:
            return x
    return None


def make(seed):
    rng = random.Random(seed)
    value = lambda: rng.choice([0.0, rng.gauss(0, 50), 10 ** rng.uniform(-12, 12), -(10 ** rng.uniform(-3, 3)), 7.0])
    return [(rng.choice(["a", "b", None]), rng.randrange(5), value(), rng.randrange(1, 9)) for _ in range(3000)] + [("a", 1, None, 3), ("a", 1, float("nan"), 3), ("b", 2, float("inf"), 1), ("a", 0, 5.0, 0), ("b", 1, 5.0, None), ("b", 1, 5.0, -2), ("none", 1, None, 1)]


@pytest.mark.parametrize("weight", ["w", None])
@pytest.mark.parametrize("alpha", [0.01, 0.2])
def test_weighted_quantiles_from_stored_parts(spark, weight, alpha):
    rows = make(3)
    df = spark.createDataFrame(rows, "g string, part int, `x.1` double, w int")
    fine = stored(sketches.quantile_sketch(df, ["g", "part"], "x.1", weight, alpha), "sketch")
    whole = sketches.merged(fine, ["g"])
    for by, sketch in ((["g"], whole), ([], sketches.merged(whole, []))):
        got = {(*r[: len(by)], r.share): r.estimate for r in sketches.quantiles(sketch, by, SHARES, alpha).collect()}
        sharp = {(*r[: len(by)], r.share): r.exact for r in sketches.refined(df, sketch, by, "x.1", weight, SHARES, alpha).collect()}
        for g in {r[0] for r in rows} - {"none"} if by else [()]:
            own = [(x, w if weight else 1) for k, _, x, w in rows if (not by or k == g) and x is not None and abs(x) < float("inf") and (not weight or (w or 0) > 0)]
            for share in SHARES:
                want, key = exact(own, share), (g, share) if by else (share,)
                assert abs(got[key] - want) <= alpha * abs(want) * (1 + 1e-6), (key, got[key], want)
                assert sharp[key] == want
        assert len(got) == len(sharp) == (3 if by else 1) * len(SHARES)


def test_sketch_is_small_and_partial(spark):
    df = spark.range(200_000).selectExpr("id % 2 as g", "rand(5) * 1000 as x")
    sketch = sketches.quantile_sketch(df, ["g"], "x")
    assert sketch.count() < 2 * 1400 and sketch.agg(F.sum("weight")).first()[0] == 200_000
    assert sketches.quantile_sketch(df.where("x < 0"), ["g"], "x").collect() == []
    assert sketches.quantiles(sketches.quantile_sketch(df.where("x < 0"), ["g"], "x"), ["g"], [0.5]).collect() == []


def test_distinct_counts_merge(spark):
    df = spark.range(60_000).selectExpr("id % 3 as g", "id % 7 as part", "if(id % 5 = 0, null, id % 20000) as v")
    fine = stored(sketches.distinct_sketch(df, ["g", "part"], "v"), "distinct")
    want = {r.g: r.n for r in df.groupBy("g").agg(F.countDistinct("v").alias("n")).collect()}
    for r in sketches.distinct_counts(fine, ["g"]).collect():
        assert abs(r.estimate - want[r.g]) <= sketches.distinct_bound() * want[r.g]
    total = sketches.distinct_counts(fine, []).first().estimate
    assert abs(total - 16_000) <= sketches.distinct_bound() * 16_000


def test_overlaps(spark):
    df = spark.range(30_000).selectExpr("'a' as g", "id as v").union(spark.range(20_000, 60_000).selectExpr("'b' as g", "id as v"))
    one, two = (F.max(F.when(F.col("g") == g, F.col("sketch"))).alias(g) for g in "ab")
    row = sketches.set_sketch(df, ["g"], "v").agg(one, two)
    got = row.select(*[c.alias(n) for n, c in sketches.overlaps(F.col("a"), F.col("b")).items()]).first()
    for name, want in (("both", 10_000), ("first", 20_000), ("either", 60_000)):
        assert abs(got[name] - want) <= sketches.overlap_bound() * 60_000


def test_ranks(spark):
    df = spark.range(50_000).selectExpr("id % 4 as part", "pow(id, 2) as x")
    fine = stored(sketches.rank_sketch(df, ["part"], "x"), "ranks")
    for r in sketches.rank_quantiles(fine, [], [0.1, 0.5, 0.99]).collect():
        assert r.n == 50_000 and abs(r.estimate**0.5 / 50_000 - r.share) <= sketches.rank_bound()
