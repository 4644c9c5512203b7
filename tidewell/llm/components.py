"""Connected components of links by large-star and small-star rounds, on DataFrames only.

Each round is two joins and three aggregations over the links; the links of a round are written to the
shared folder, so rounds neither lengthen the lineage nor depend on one executor. A node with very
many links is split by the skew handling of sort-merge joins, and its minimum is taken before the
shuffle. Nothing is gathered at the driver but whether a round is the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.workspace import Workspace


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of its neighbours and itself: a > b, some more than once."""
    # both ways from one reading of the links
    both = links.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(down: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them; down: links with a > b."""
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
    return moved.where("a <> b").distinct()


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, root) of every node of the links (a, b: long): root is the least node it reaches.

    Links may be in any direction, repeated, or from a node to itself. No links, no nodes.
    """
    now, k = ws.put(links.select("a", "b").where("a is not null and b is not null"), f"{name}-0"), 0
    while True:
        k += 1
        now = ws.put(_small_star(_large_star(now)), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
        # done once every node is linked to one other, and that to none
        down, up = (F.struct(F.col(c).alias("node"), F.lit(x).alias("down"), F.lit(1 - x).alias("up")) for c, x in (("a", 1), ("b", 0)))
        ends = now.select(F.inline(F.array(down, up))).groupBy("node").agg((F.sum("down") + F.max("up")).alias("n"))
        if ends.where("n > 1").isEmpty():
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
