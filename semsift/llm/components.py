"""Connected components of an edge table by alternating star contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semsift.llm.common import release, stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every node hands its larger (or smaller) neighbours to the
    smallest node it knows. ``edges``: ``(u, v)`` with ``u > v``."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    to = both.join(least, "u")
    if large:
        out = to.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = to.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """``(node, component)``, the component being its smallest node, for every node with an
    edge. Each round is two aggregations and two equi-joins on a node, staged, so a node
    with a third of all edges costs a split join and no task its whole neighbourhood."""
    edges = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                  .where("u != v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        old, edges = edges, stage(_star(_star(edges, large=True), large=False), "edges")
        release(old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .union(edges.select("v", "v").distinct())
