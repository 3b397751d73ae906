"""Weakly connected components by alternating large-star and small-star rounds.

Each round links nodes to the smallest node they know of; edges never grow in number beyond the input's, and the rounds grow
with the logarithm of the longest path. Every round is written to the shared folder, so lineage stays short. A node's edges
meet its least neighbour in SALTS parts, so the centre of a large star isn't one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.runtime import materialize

#: Parts of a node's edges.
SALTS = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (a, b) with m, the least of a's neighbours, from least (a, m)."""
    left = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    right = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are linked to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _with_least(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours are linked to the least of these. Edges go from greater to lesser."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = _with_least(edges, least)
    return down.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of every node that has an edge to another one; component is the smallest id reachable.

    Edges with a null end and loops are left out; direction and repeats don't matter.
    """
    edges = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    edges = materialize(edges.distinct(), "wcc")
    while True:
        edges = materialize(_small_star(_large_star(edges)), "wcc")
        # Done when every edge goes to a node that has no lesser neighbour, and every node has one edge.
        ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("id").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).filter("down > 1 or (down > 0 and up > 0)")
        if open_.isEmpty():
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
