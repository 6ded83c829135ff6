"""Connected components of an edge table: alternating large-star and small-star rounds.

Each round joins edges with the least neighbour of a node, never a node with all its neighbours in
one place: minima are pre-aggregated and a hot node is a skewed join that AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordtide.llm.common import Scratch


def _star(sym: DataFrame, large: bool) -> DataFrame:
    """sym (u, v). Every neighbour v of u (greater ones, or no greater ones) is tied to the least one."""
    if not large:
        sym = sym.filter("v < u")
    least = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = sym.join(least, "u")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes that have an edge in edges (a, b); component: the least node.

    Self edges, nulls, repeats and either direction are allowed. An empty table gives an empty one.
    """
    now = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    mark = sign(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        big = _star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), True)
        after = scratch.keep(_star(big, False), "edges")
        new = sign(after)
        scratch.drop(now)
        now = after
        if tuple(new) == tuple(mark):
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
