"""Packing into optimal length buckets.

A histogram of all lengths is gathered, a row for each length that occurs: its size is bounded by the
longest text, not by the number of documents. Dynamic programming over it chooses the bucket boundaries
of least padding; the cuts of longer prefixes lie farther right, so each row of the program is found by
divide and conquer. Inside each bucket, documents in the order of their key form batches that hold at
most a budget of padded tokens.

Places in a bucket are global ranks: rows are dealt by range of (bucket, key), numbered inside each
part, and shifted by the count of the parts before. No bucket is gathered in one task.

Defined cases: a null text has length 0 and goes to the first bucket. A document longer than the
budget makes a batch of its own; nothing is cut. Repeated rows are packed as often as they come;
null keys come first. Only the key and the text of the input are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.workspace import Workspace

#: Buckets, at most.
BUCKETS = 16
#: Padded tokens of a batch.
BUDGET = 16_384

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def boundaries(bounds: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The at most ``buckets`` upper bounds, out of ascending ``bounds``, of the least padded total.

    cost[j] is the padded total of the lengths up to j. With one bucket more, lengths i+1..j are padded
    to bounds[j]. Of equal costs the earliest cut is taken, and the fewest buckets.
    """
    n = len(bounds)
    if not n:
        return []
    before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    b = bounds.astype(np.int64)
    cost = b * before[1:]
    cuts: list[np.ndarray] = []
    best = [int(cost[-1])]
    for _ in range(1, min(buckets, n)):
        cost, cut = _one_more(b, before, cost)
        cuts.append(cut)
        best.append(int(cost[-1]))
    level, j, out = int(np.argmin(best)), n - 1, []
    while True:
        out.append(int(bounds[j]))
        if not level:
            return out[::-1]
        j = int(cuts[level - 1][j])
        level -= 1


def _one_more(b: np.ndarray, before: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs and first best cuts with one bucket more. The middles of all open ranges are solved together."""
    n = len(b)
    new, cut = np.full(n, 1 << 62, np.int64), np.zeros(n, np.int64)
    low, high, first, last = (np.array([x]) for x in (1, n - 1, 0, n - 2))
    while len(low):
        mid = (low + high) // 2
        size = np.minimum(last, mid - 1) - first + 1
        start = np.cumsum(size) - size
        i = np.arange(size.sum()) - np.repeat(start - first, size)
        value = cost[i] + np.repeat(b[mid], size) * (np.repeat(before[mid + 1], size) - before[i + 1])
        new[mid] = np.minimum.reduceat(value, start)
        cut[mid] = at = np.minimum.reduceat(np.where(value == np.repeat(new[mid], size), i, n), start)
        low, high, first, last = (np.concatenate(x) for x in ((low, mid + 1), (mid - 1, high), (first, at), (at, last)))
        open_ = low <= high
        low, high, first, last = low[open_], high[open_], first[open_], last[open_]
    return new, cut


def pack(df: DataFrame, length: Column | None = None, key: str = "doc_id", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """A row for each row of df: key, n_tokens, bucket (from 0), bucket_len, batch_id, slot.

    ``length``: the number of tokens of a row; by default the words of ``text``. Batch ids run from
    0 through the buckets; slots from 0 in a batch. Padded to bucket_len, a batch has at most
    ``budget`` tokens, or one document.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "packing")
    lengths = ws.put(df.select(F.col(f"`{key}`").alias("k"), (n_words() if length is None else length).cast("long").alias("n_tokens")), "lengths")
    histogram = np.array([tuple(r) for r in lengths.groupBy("n_tokens").count().collect()], np.int64).reshape(-1, 2)
    histogram = histogram[np.argsort(histogram[:, 0])]
    tops = boundaries(histogram[:, 0], histogram[:, 1], buckets)
    sizes = np.bincount(np.searchsorted(tops, histogram[:, 0]), histogram[:, 1], len(tops)).astype(int).tolist()
    room = [max(1, budget // max(t, 1)) for t in tops]
    start = np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()
    first = np.concatenate([[0], np.cumsum([-(-s // r) for s, r in zip(sizes, room, strict=True)])]).astype(int).tolist()

    bucket = sum((F.when(F.col("n_tokens") > t, 1).otherwise(0) for t in tops[:-1]), F.lit(0))
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values or [0]]), F.col("bucket") + 1)
    rows = lengths.withColumn("bucket", bucket).withColumn("tie", F.monotonically_increasing_id())
    dealt = ws.put(rows.repartitionByRange("bucket", "k", "n_tokens", "tie").withColumn("part", F.spark_partition_id()), "dealt")
    counts = sorted(dealt.groupBy("part").count().collect())
    shifts, total = [], 0
    for part, n in counts:
        shifts.append((part, total))
        total += n
    place = F.row_number().over(Window.partitionBy("part").orderBy("bucket", F.col("k").asc_nulls_first(), "n_tokens", "tie"))
    numbered = dealt.withColumn("place", place)
    table = spark.createDataFrame(shifts, "part int, shift long")  # a row for each partition
    at = F.col("shift") + F.col("place") - 1 - pick(start[:-1])
    placed = numbered.join(F.broadcast(table), "part").withColumn("at", at).withColumn("room", pick(room))
    return placed.select(
        F.col("k").alias(key),
        "n_tokens",
        F.col("bucket").cast("int").alias("bucket"),
        pick(tops).alias("bucket_len"),
        (pick(first[:-1]) + F.floor(F.col("at") / F.col("room"))).cast("long").alias("batch_id"),
        (F.col("at") % F.col("room")).cast("int").alias("slot"),
    )


#: The same in DuckDB: the program of boundaries() as a recursive query over the histogram.
ORACLE_SQL = f"""
WITH RECURSIVE lengths AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_tokens FROM documents
), bins AS (
  SELECT row_number() OVER (ORDER BY most) AS j, most, CAST(sum(n) OVER (ORDER BY most) AS BIGINT) AS upto
  FROM (SELECT n_tokens AS most, count(*) AS n FROM lengths GROUP BY n_tokens)
), program AS (
  SELECT 1 AS level, j, most * upto AS cost, [most] AS tops FROM bins
  UNION ALL
  SELECT p.level + 1, t.j, min(p.cost + t.most * (t.upto - f.upto)), list_append(arg_min(p.tops, (p.cost + t.most * (t.upto - f.upto), p.j)), t.most)
  FROM program p JOIN bins f ON p.j = f.j JOIN bins t ON t.j > p.j WHERE p.level < {BUCKETS} GROUP BY p.level, t.j, t.most
), best AS (
  SELECT tops FROM program WHERE j = (SELECT max(j) FROM bins) ORDER BY cost, level LIMIT 1
), dealt AS (
  SELECT doc_id, n_tokens, CAST(len(list_filter(tops, lambda x: x < n_tokens)) AS INTEGER) AS bucket, tops FROM lengths, best
), roomy AS (
  SELECT *, tops[bucket + 1] AS bucket_len, greatest(1, {BUDGET} // greatest(tops[bucket + 1], 1)) AS room FROM dealt
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, n_tokens) - 1 AS place FROM roomy
), firsts AS (
  SELECT bucket, coalesce(sum(batches) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM (SELECT bucket, max(place // room) + 1 AS batches FROM placed GROUP BY bucket)
)
SELECT doc_id, n_tokens, bucket, bucket_len, CAST(first + place // room AS BIGINT) AS batch_id, CAST(place % room AS INTEGER) AS slot
FROM placed JOIN firsts USING (bucket)"""
