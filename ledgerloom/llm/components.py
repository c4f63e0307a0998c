"""Connected components by alternating large-star and small-star steps.

Edges are kept once, from the greater node ``u`` to the smaller ``v``.  A step needs the least
neighbour of each node only: a small table of its own, so that both sides of the join are plain
shuffles, which adaptive execution splits where a node has very many links.  Nothing gathers in a
task or on the driver.  Lineage is cut by a table in the shared folder after each round; rounds grow
with the logarithm of the longest path.

Defined results: loops count for nothing, repeated edges once; an edge with a null end links nothing;
nodes that no edge names are not in the result, nor are roots; ids of any kind that has an order will do;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, keep, release


def _least(edges: DataFrame) -> DataFrame:
    return keep(edges.groupBy("u").agg(F.min("v").alias("m")))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Hangs every greater neighbour of a node to the least of the node's neighbours and itself."""
    below = least.withColumnRenamed("u", "v")
    return edges.join(below, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Hangs a node and all its smaller neighbours to the least of these."""
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, root)`` for every node of ``edges`` other than roots; ``root`` is the smallest id reachable.

    Loops and repeated edges are harmless; no edges give no rows.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == mark or not state.n:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        mark = state
        first = _least(now)
        middle = cut(_large_star(now, first), "edges")
        second = _least(middle)
        after = cut(_small_star(middle, second), "edges")
        release(first, second)
        drop_cut(now, middle)
        now = after
