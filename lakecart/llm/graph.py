"""Connected components over an edge table, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of node and neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (both.join(low, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to its smallest neighbour."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge; component: its smallest node.

    Alternates large-star and small-star steps (a number of rounds that grows with the
    logarithm of the number of nodes); each round is a written table, so an executor that
    is lost costs one round at most, and a round's table goes when the next one is written.
    A hub's edges meet in an equi-join that AQE can split and in map-side combined minima.
    Edges with a null end and loops are dropped; an empty edge table gives an empty result.
    """
    now = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
                      .where("a <> b").distinct(), f"{name}-0")
    seen = None
    for turn in range(1, max_rounds + 1):
        before, now = now, materialize(_small_star(_large_star(now)), f"{name}-{turn}")
        discard(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
