"""Connected components of a graph given as a table of edges.

Alternating large-star and small-star steps: each is one minimum per node,
combined before the shuffle, and one equality join back. The number of edges never
grows, and no neighbourhood is ever gathered in one place. Every step is written
as a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.llm.shared import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (``large``) or smaller neighbours to the least label around it.

    Edges are (a, b) with a > b.
    """
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        return around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    linked = edges.join(least, "a")
    moved = linked.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node reachable.

    Repeated edges and edges of a node to itself change nothing. An empty table gives an empty one.
    """
    apart = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialise(apart.distinct(), "edges")
    while True:
        # Converged when the edges are stars around their least node: no node is both a centre and a leaf.
        rest = now.select("b").distinct().join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        manifold = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
        if rest.isEmpty() and manifold.isEmpty():
            break
        now = materialise(_star(_star(now, large=True), large=False), "edges")
    centres = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
