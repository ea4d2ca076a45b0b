"""Connected components of a link table, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm.common import saved

# Edges of one part, and the least number of parts: each part of a shuffle is some files, however few its rows.
PART_EDGES, LEAST_PARTS = 500_000, 8


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge points from the larger node ``u`` to the smaller ``v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return (
        moved.where("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """The least node reachable from each linked node: columns ``u`` and ``v``.

    ``edges`` has two columns ``u`` and ``v`` of one ordered type; direction,
    repeats and self-links don't matter. A node without links isn't returned.
    Large and small stars alternate until every edge points at its component's
    least node. Each round is written to the checkpoint folder; its work is
    grouped and joined by node, and the number of edges never grows.
    """
    edges = saved(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    # The number of edges never grows, so these parts are enough for every round.
    parts = max(LEAST_PARTS, -(-edges.count() // PART_EDGES))
    edges = edges.coalesce(parts)
    while True:
        # Stars everywhere: each node has one edge, and no target has an edge of its own.
        repeated = edges.groupBy("u").count().where("count > 1")
        chained = edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi")
        if repeated.isEmpty() and chained.isEmpty():
            return edges
        edges = saved(_small_star(_large_star(edges).coalesce(parts)).coalesce(parts))
