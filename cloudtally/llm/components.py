"""Connected components by alternating star contractions, each round stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudtally.runtime import durable

ROUNDS = 60


def _towards(edges: DataFrame) -> DataFrame:
    """Every node of an edge and the smallest node it is joined with, itself included."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    return both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("b > a")
    return both.join(_towards(edges), "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the smallest of those. Edges lead from a to a smaller b."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    sides = edges.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return sides.union(low.select("a", F.col("low").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("coalesce(sum(cast(xxhash64(a, b) as decimal(38,0))), 0)")).first())


def components(edges: DataFrame, low: str = "a", high: str = "b") -> DataFrame:
    """node and component (its smallest node) for every node of the links; no row for nodes without any.

    Loops, repeated links and links with a null end are ignored. The number of rounds grows with the
    logarithm of the longest chain; every aggregate combines before its shuffle, so a node with very
    many links is no hot key, and Spark splits the joins' hot partitions.
    """
    a, b = F.col(low), F.col(high)
    edges = durable(edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = _state(edges)
    for _ in range(ROUNDS):
        if not state[0]:
            break
        edges = durable(_small_star(_large_star(edges)))
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select("b", "b").distinct())
