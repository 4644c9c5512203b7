"""What filters do to each other: every order of them, from edges of the lattice of applied subsets.

A document is known by the set of filters that it fails. An edge of the lattice is a pair (filters already
applied, filter applied next); with five filters there are 80. Documents of a part with the same failures
are counted first, and each such group adds its numbers to all edges: what the next filter keeps, removes,
or would have removed were it not gone. An order of the filters is a path through the lattice, so that each
of its steps is an edge: the 600 steps of all 120 orders are joined to the summed edges. Work on documents
is one pass over the texts and joins of numbers of fixed size; nothing grows with the number of orders.

The last filter, of repeated texts, looks at the whole table: a text's SHA-256 stands for it. The least
doc_id of each digest is aggregated before the shuffle and joined back, so a text of very many documents
is split by the join and never stands in one task.

Defined cases: a null text is an empty one (no words, so that it fails a least number of words; empty texts
are identical), a null source is ''. A null doc_id is neither smaller nor larger than another and has no
label. Rows that share doc_id and text are documents of their own, none of them smaller than the other. A
doc_id with several labels counts as good (toxic) if one of them says so. Only the named columns are
read, others may have any name. An empty table gives an empty one. The words of one text are held in memory, some
fifteen times its size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.workspace import Workspace


@dataclass(frozen=True)
class Filter:
    """``fails``: of a text and its words; None: of documents whose text a smaller doc_id has."""

    letter: str
    fails: Callable[[Column, Column], Column] | None


FILTERS = (
    Filter("A", lambda text, words: F.size(words) < 200),
    Filter("B", lambda text, words: F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 50),
    Filter("C", lambda text, words: F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 2),
    Filter("D", lambda text, words: text.rlike(r"[#$%&*|]")),
    Filter("E", None),
)


def edges(n: int) -> list[tuple[int, int, int]]:
    """(filters applied, the next one, number of orders that pass here): sets are masks of bits, the next one has a number."""
    out = []
    for size in range(n):
        for applied in combinations(range(n), size):
            for nxt in sorted(set(range(n)) - set(applied)):
                out.append((sum(1 << k for k in applied), nxt, factorial(size) * factorial(n - 1 - size)))
    return out


def steps(letters: str) -> list[tuple[str, int, int, int]]:
    """(order, step from 1, filters applied before it, the step's filter) of every order."""
    out = []
    for order in permutations(range(len(letters))):
        applied = 0
        for at, nxt in enumerate(order):
            out.append(("".join(letters[k] for k in order), at + 1, applied, nxt))
            applied |= 1 << nxt
    return out


def failures(df: DataFrame, filters: tuple[Filter, ...] = FILTERS, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, failed): a row for each row of df, ``failed`` the mask of the filters that it fails."""
    ws = Workspace(df.sparkSession, "filteraudit")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), whole.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    own = sum((F.when(f.fails(F.col("text"), F.col("words")), 1 << n).otherwise(0) for n, f in enumerate(filters) if f.fails), F.lit(0))
    # numbers of fixed size from here on; texts are read once
    facts = ws.put(rows.select("id", "part", own.cast("int").alias("failed"), F.unhex(F.sha2("text", 256)).alias("digest")), "facts")
    later = [n for n, f in enumerate(filters) if f.fails is None]
    if later:
        first = facts.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("most > least").select("digest", "least")
        repeated = F.when(F.col("id") > F.col("least"), sum(1 << n for n in later)).otherwise(0)
        facts = facts.join(first, "digest", "left").withColumn("failed", F.col("failed") + repeated)
    return facts.select("id", "part", "failed")


def audit(df: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step, with counts of the part's documents.

    Columns: part, filter_order, step, kept, removed, redundant (failing the step's filter, but removed
    before), unique_fails (failing it only), good_lost and toxic_lost (of those removed here), shapley (what
    the step's filter removes, summed over all orders). Labels: the key, quality and toxic.
    """
    spark, letters = df.sparkSession, "".join(f.letter for f in filters)
    marks = labels.select(F.col(f"`{key}`").alias("id"), "quality", "toxic").groupBy("id").agg(F.max(F.when(F.col("quality") == 1, 1)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1)).alias("bad"))
    groups = failures(df, filters, key, text, part).join(marks, "id", "left").groupBy("part", "failed").agg(F.count("*").alias("n"), F.count("good").alias("good"), F.count("bad").alias("bad"))

    lattice = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(k).alias("next"), F.lit(w).alias("weight")) for s, k, w in edges(len(filters))])
    met = groups.withColumn("edge", F.explode(lattice)).select("part", "failed", "n", "good", "bad", "edge.*")
    bit = F.expr("shiftleft(1, next)")
    fails, gone = F.col("failed").bitwiseAND(bit) != 0, F.col("failed").bitwiseAND(F.col("applied")) != 0
    where = lambda condition, value="n": F.sum(F.when(condition, F.col(value)).otherwise(0))
    summed = met.groupBy("part", "applied", "next", "weight").agg(
        where(~fails & ~gone).alias("kept"),
        where(fails & ~gone).alias("removed"),
        where(fails & gone).alias("redundant"),
        where(F.col("failed") == bit).alias("unique_fails"),
        where(fails & ~gone, "good").alias("good_lost"),
        where(fails & ~gone, "bad").alias("toxic_lost"),
    )
    # of each filter 2^(n-1) edges
    summed = summed.withColumn("shapley", F.sum(F.col("removed") * F.col("weight")).over(Window.partitionBy("part", "next")))
    paths = spark.createDataFrame(steps(letters), "filter_order string, step int, applied int, next int")
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    # n * n! rows, whatever the input
    return summed.join(F.broadcast(paths), ["applied", "next"]).select("part", "filter_order", "step", *counts)


#: The same in DuckDB, by sending every document through every order.
ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), failed AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM words
), docs AS (
  SELECT part, fails, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad
  FROM (SELECT row_number() OVER () AS r, * FROM failed) LEFT JOIN labels USING (doc_id) GROUP BY r, part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders
), walked AS (
  SELECT part, filter_order, step, good, bad, fails, substr(filter_order, step, 1) AS f, contains(fails, substr(filter_order, step, 1)) AS hit,
    step > 1 AND regexp_matches(fails, '[' || substr(filter_order, 1, step - 1) || 'x]') AS gone FROM docs, steps
), counted AS (
  SELECT part, filter_order, step, f, count(*) FILTER (WHERE NOT hit AND NOT gone) AS kept, count(*) FILTER (WHERE hit AND NOT gone) AS removed,
    count(*) FILTER (WHERE hit AND gone) AS redundant, count(*) FILTER (WHERE fails = f) AS unique_fails,
    count(*) FILTER (WHERE hit AND NOT gone AND good) AS good_lost, count(*) FILTER (WHERE hit AND NOT gone AND bad) AS toxic_lost
  FROM walked GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted"""
