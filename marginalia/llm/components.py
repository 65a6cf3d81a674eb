"""Connected components of an edge table by alternating star rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on ``(u, v)`` with ``u > v``: neighbours of a node hang onto its smallest neighbour.

    The smallest neighbour comes from an aggregate and a join, never from a collected neighbour list;
    the join's other side has one row per node, so Spark can split a hub's rows.
    """
    if large:
        near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Each round is a large-star and a small-star step, written to the shared folder; the rounds grow
    with the logarithm of the longest path. Self loops and repeated edges are allowed; nodes without
    an edge to another node do not appear. An empty table gives an empty result.
    """
    now = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r.n, r.s

    seen = state(now)
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most):
        now = checkpointed(_star(_star(now, True), False))
        new = state(now)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
