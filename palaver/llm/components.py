"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is an aggregate by node (partial minima first) and a join back to the edges, so a hub's neighbours are never
gathered; each round's edges are written to the shared folder. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import Scratch


def _star(edges: DataFrame) -> DataFrame:
    """(u, v) edges, u > v, after one large-star and one small-star step."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.join(least, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # a node that is its neighbourhood's least keeps its edge; edges stay oriented downwards
    large = large.distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(down, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(down.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int | None = None) -> DataFrame:
    """(node, component) of every node in (a, b); component is the smallest node reachable. Rounds go on until one changes
    nothing; with ``most_rounds`` it is an error if that many do not get there."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before, last = None, None
    for k in count():
        if k == most_rounds:
            raise RuntimeError(f"components still changed after {most_rounds} rounds")
        now = scratch.write(now if k == 0 else _star(now), f"components{k}")
        if last:
            scratch.drop(last)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before or mark[0] == 0:
            break
        before, last = mark, f"components{k}"
    # stars only: every u points at its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
