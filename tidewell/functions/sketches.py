"""Mergeable summaries of groups: stored once for fine groups, added up for coarse ones.

Quantiles with weights
    A value's bucket is the whole part of its logarithm, so that all values of a bucket are within ``alpha``
    of its middle, relative to the value. A sketch is a plain table of (group, bucket, weight): Spark builds it with
    partial aggregation, it is merged by adding weights, and its size is bounded by the range of the values, not by
    their number. Where the exact quantile is wanted, the sketch tells its bucket, and only the rows in
    that bucket are sorted.

Distinct counts, ranks and overlaps
    Binary sketches of Spark's own functions (HyperLogLog, KLL, theta), with their bounds stated here.

Values that are null, not finite, or of a weight that is null or not above zero are not counted. A group without any
has no row in a quantile sketch. An empty table gives an empty sketch.
"""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.naming import quoted

#: Largest relative error of a quantile.
ALPHA = 0.01
#: Above the number of any bucket, so that those of negative values come before that of zero.
_BEYOND = 1 << 20
#: Size parameters: 2^LG registers or entries, K items a level.
LG, K = 12, 2000


# quantiles with weights


def _gamma(alpha: float) -> float:
    return (1 + alpha) / (1 - alpha)


def bucket(value: Column, alpha: float = ALPHA) -> Column:
    """The number of a value's bucket, in the order of values."""
    x = value.cast("double")
    size = F.ceil(F.log(F.abs(F.when(x != 0, x))) / log(_gamma(alpha))) + _BEYOND
    return F.when(x == 0, 0).otherwise(F.signum(x) * size).cast("long")


def middle(number: Column, alpha: float = ALPHA) -> Column:
    """The value that stands for a bucket: within alpha, relatively, of each of its values."""
    size = F.pow(F.lit(_gamma(alpha)), F.abs(number) - _BEYOND) * (2 / (_gamma(alpha) + 1))
    return F.when(number == 0, 0.0).otherwise(F.signum(number) * size)


def _counted(df: DataFrame, by: list[str], value: str, weight: str | None) -> DataFrame:
    x, w = F.col(quoted(value)), F.lit(1) if weight is None else F.col(quoted(weight))
    finite = x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))
    return df.where(finite & (w > 0)).select(*[quoted(c) for c in by], x.alias("__value"), w.alias("__weight"))


def quantile_sketch(df: DataFrame, by: list[str], value: str, weight: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """(by, bucket, weight): how much weight each group has in each bucket. Without ``weight`` every row has 1."""
    rows = _counted(df, by, value, weight)
    return rows.groupBy(*[quoted(c) for c in by], bucket(F.col("__value"), alpha).alias("bucket")).agg(F.sum("__weight").alias("weight"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """A sketch of fewer group columns; also of several sketches that were put together by union."""
    return sketch.groupBy(*[quoted(c) for c in by], "bucket").agg(F.sum("weight").alias("weight"))


def _found(sketch: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """(by, share, bucket, before, total): the first bucket at which a share of the weight is reached, and the weight before it."""
    keys = [quoted(c) for c in by]
    sofar = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    placed = sketch.withColumn("__sum", F.sum("weight").over(sofar)).withColumn("__all", F.sum("weight").over(Window.partitionBy(*keys)))
    placed = placed.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    reached = (F.col("__sum") >= F.col("share") * F.col("__all")) & (F.col("__sum") - F.col("weight") < F.greatest(F.col("share") * F.col("__all"), F.lit(5e-324)))
    return placed.where(reached).select(*keys, "share", "bucket", (F.col("__sum") - F.col("weight")).alias("before"), F.col("__all").alias("total"))


def quantiles(sketch: DataFrame, by: list[str], shares: list[float], alpha: float = ALPHA) -> DataFrame:
    """(by, share, estimate): within alpha of the least value up to which the group has the share of its weight."""
    return _found(sketch, by, shares).select(*[quoted(c) for c in by], "share", middle(F.col("bucket"), alpha).alias("estimate"))


def refined(df: DataFrame, sketch: DataFrame, by: list[str], value: str, weight: str | None, shares: list[float], alpha: float = ALPHA) -> DataFrame:
    """(by, share, exact): the exact quantiles of df, of which ``sketch`` is the sketch: only rows of the buckets in question are sorted."""
    keys = [quoted(c) for c in by]
    found = _found(sketch, by, shares).toDF(*[f"__k{n}" for n in range(len(by))], "share", "bucket", "before", "total")
    same = F.col("__bucket") == F.col("bucket")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{n}"))
    rows = _counted(df, by, value, weight).withColumn("__bucket", bucket(F.col("__value"), alpha)).join(found, same)
    values = rows.groupBy(*keys, "share", "before", "total", "__value").agg(F.sum("__weight").alias("__weight"))
    sofar = Window.partitionBy(*keys, "share").orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)
    reached = values.withColumn("__sum", F.col("before") + F.sum("__weight").over(sofar)).where(F.col("__sum") >= F.col("share") * F.col("total"))
    return reached.groupBy(*keys, "share").agg(F.min("__value").alias("exact"))


def within(estimate: Column, exact: Column, alpha: float = ALPHA) -> Column:
    """Whether an estimate keeps to the bound (but for the last digits of the logarithm)."""
    return F.abs(estimate - exact) <= F.abs(exact) * (alpha * (1 + 1e-6))


# distinct counts


def distinct_bound(lg: int = LG) -> float:
    """Relative error of a distinct count, three standard errors."""
    return 3 * 1.04 / sqrt(1 << lg)


def distinct_sketch(df: DataFrame, by: list[str], column: str, lg: int = LG) -> DataFrame:
    """(by, sketch): numbers, texts or binaries, nulls not counted."""
    return df.groupBy(*[quoted(c) for c in by]).agg(F.hll_sketch_agg(quoted(column), lg).alias("sketch"))


def distinct_counts(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, estimate) from sketches of finer groups."""
    return sketches.groupBy(*[quoted(c) for c in by]).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


# overlaps of sets


def overlap_bound(lg: int = LG) -> float:
    """Error of the size of an overlap or a difference, in proportion to the union: three standard errors."""
    return 3 / sqrt(1 << lg)


def set_sketch(df: DataFrame, by: list[str], column: str, lg: int = LG) -> DataFrame:
    """(by, sketch): what of two groups' values are in both, or in one only, can be asked later."""
    return df.groupBy(*[quoted(c) for c in by]).agg(F.theta_sketch_agg(quoted(column), lg).alias("sketch"))


def overlaps(one: Column, two: Column) -> dict[str, Column]:
    """Estimates of the sizes of ``both``, ``first`` (only) and ``either``."""
    size = F.theta_sketch_estimate
    return {"both": size(F.theta_intersection(one, two)), "first": size(F.theta_difference(one, two)), "either": size(F.theta_union(one, two))}


# ranks


def rank_bound(k: int = K) -> float:
    """Error of a rank in proportion to the number of values; twice what is kept to in 99 of 100 cases."""
    return 2 * 2.446 / k**0.9433


def rank_sketch(df: DataFrame, by: list[str], value: str, k: int = K) -> DataFrame:
    """(by, sketch, n): for quantiles whose rank, not whose value, must be near."""
    x = F.col(quoted(value)).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*[quoted(c) for c in by]).agg(F.kll_sketch_agg_double(x, k).alias("sketch"), F.count("*").alias("n"))


def rank_quantiles(sketches: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """(by, share, estimate, n) from sketches of finer groups."""
    keys = [quoted(c) for c in by]
    whole = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    each = [F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("estimate")) for s in shares]
    return whole.select(*keys, "n", F.explode(F.array(*each)).alias("__q")).select(*keys, "__q.share", "__q.estimate", "n")
