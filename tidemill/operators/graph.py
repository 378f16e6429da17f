"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sources.storage import save


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: neighbours of a node are tied to the smallest of them and itself."""
    both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least.hint("merge"), "u")  # as many rows as nodes: never through the driver
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, root: every node with an edge, and the smallest node it can reach.

    edges has the long columns u and v; loops and repeated edges do no harm. The
    work stays in Spark: a hub's edges are only ever pre-aggregated or joined, so
    adaptive execution can split them, and each round's edges are stored. Rounds
    grow with the logarithm of the nodes.
    """
    edges = save(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    before = _state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        edges = save(_star(_star(edges, large=True), large=False), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are still changing after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
