"""Connected components by alternating large and small stars.

Every step is a grouped minimum and a join, so no component gathers in one place; what a step
leaves is kept in the shared folder.  A round is begun only if the edges are not stars already, and
edges are read by as many tasks as their number asks for: the driver keeps something of every
stage and task, so rounds that change nothing and tasks without rows cost its memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.session import cut

#: Edges that one task reads, a few MB.
EDGES_A_TASK = 50_000


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _progress(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and how many nodes keep them from being stars: below two others, or below one and above one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("below")).union(edges.select("b", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.min("below").alias("least"))
    between = (F.col("below") > 1) | (F.col("below") == 1) & (F.col("least") == 0)
    n, left = nodes.agg(F.sum("below"), F.count_if(between)).first()
    return n or 0, left


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with, for every node ``a`` or ``b`` of an edge."""
    ordered = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut(ordered.distinct())
    n, left = _progress(edges)
    n_tasks = -(-n // EDGES_A_TASK) or 1  # a round makes no edges more
    edges = edges.coalesce(n_tasks)
    while left:
        # `_small` uses what `_large` finds three times
        edges = cut(_small(cut(_large(edges)).coalesce(n_tasks)).distinct()).coalesce(n_tasks)
        _, left = _progress(edges)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
