"""Connected components by alternating large-star and small-star.

Large-star links every larger neighbour of a node to the smallest node in its
neighbourhood; small-star links the smaller neighbours and the node itself to
the smallest of them. The two alternate until no edge changes; the graph is
then a set of stars whose centre is the smallest id. Neighbourhood minima are
grouped aggregates with map-side combination, and the join back to the edges
is salted, so a node with very many edges is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_lookup, settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        salted_lookup(both.where("v > u"), least, ["u"], "inner", F.col("v"), merge=True)
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u != v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = salted_lookup(down, least, ["u"], "inner", F.col("v"), merge=True).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u != v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (u long, v long) to (node long, component long), component being the smallest id reachable.

    Nodes without an edge to another node are absent: their component is
    themselves. Self-loops, repeated edges and null ends are ignored. An empty
    table gives an empty table. Raises if the rounds do not suffice rather than
    returning unfinished components.
    """
    now = settle(edges.where("u is not null and v is not null and u != v").select(F.col("u").cast("long"), F.col("v").cast("long")).distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        now = settle(_small_star(_large_star(now)), "cc")
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            # u has one centre, and the centres are smallest: every node but the centre is listed once
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = (seen["n"], seen["h"])
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
