"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, store


def _is_stars(edges: DataFrame) -> bool:
    """True if every child has one parent and no parent is a child."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionAll(
        edges.select(F.col("v").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    seen = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return seen.where("child > 1 OR (child = 1 AND parent = 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionAll(
        edges.select(F.col("v").alias("a"), F.col("u").alias("b"))
    )
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.join(low, "a")
        .where("b > a")
        .select(F.col("b").alias("u"), F.least("a", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``links`` (u long, v long).

    component is the smallest node reachable, the node itself included. Each round is
    written to the shared folder and the one before it is deleted; the number of rounds
    grows with the logarithm of the longest chain. No step gathers a component: a node
    with very many links is pre-aggregated in the minimum, and its join can be split by
    adaptive execution. Null ends and loops are ignored; without links there are no rows.
    """
    edges = store(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "links",
    )
    while not _is_stars(edges):
        after = store(_small_star(_large_star(edges)), "links")
        release(edges)
        edges = after
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(own)


def named_components(nodes: DataFrame, node: str, links: DataFrame) -> DataFrame:
    """Rows (``node``, component_id) for every row of ``nodes`` (``node``, least_id).

    component_id is the smallest least_id, other than null, of the nodes that links (u, v)
    connect; null where there is none. A large component is pre-aggregated in the minimum.
    """
    grouped = connected_components(links).select(F.col("node").alias(node), "component")
    placed = nodes.select(node, "least_id").join(grouped, node, "left")
    linked = placed.where("component IS NOT NULL")
    least = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return linked.join(least, "component").select(node, "component_id").unionAll(placed.where("component IS NULL").select(node, F.col("least_id").alias("component_id")))
