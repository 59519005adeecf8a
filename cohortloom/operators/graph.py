"""Chains and components of persons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder of the session."""
    folder, context = shared_dir(df.sparkSession), df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


def survivors(merges: DataFrame) -> DataFrame:
    """Rows (id, survivor): the end of each chain id -> merged_into (ER10).

    Each round doubles the length of a step, so every round ends some chains unless only
    cycles are left: their members, and what leads into them, survive as the cycle's
    smallest id.
    """
    own = merges.where("merged_into IS NOT NULL").select("id", F.col("merged_into").alias("to"), F.col("id").alias("low"))
    own, before = cut_lineage(own), None
    while True:
        onward = own.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("low").alias("next_low"))
        step = own.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.least("low", F.coalesce("next_low", "low")).alias("low"), F.col("next").isNotNull().alias("moving"))
        step = cut_lineage(step)
        own = step.select("id", "to", "low")
        state = tuple(step.where("moving").agg(F.count(F.lit(1)), F.sum(F.xxhash64("low").cast("decimal(38,0)"))).first())
        if state[0] == 0:
            return own.select("id", F.col("to").alias("survivor"))
        if state == before:
            break
        before = state
    cycle = own.select(F.col("id").alias("to"), F.col("low").alias("end"))
    return own.join(cycle, "to", "left").select("id", F.coalesce("end", "to").alias("survivor"))


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) over links (a, b): the smallest reachable id of every end.

    Links become stars: in each round every node hands its larger neighbours to the smallest
    one, then every node keeps its smallest neighbour and hands it the others. Rounds grow
    with the logarithm of the longest chain; minima are pre-aggregated, nothing is gathered.
    """
    one = lambda a, b: edges.select(F.col(a).alias("id"), F.col(b).alias("to"))
    ends = cut_lineage(one("a", "b").union(one("b", "a")).where("id IS NOT NULL AND to IS NOT NULL").distinct())
    links = cut_lineage(ends.where("id > to"))
    while not _stars(links):
        both = links.union(links.select(F.col("to").alias("id"), F.col("id").alias("to")))
        centre = both.groupBy("id").agg(F.min("to").alias("low")).withColumn("low", F.least("low", "id"))
        outward = both.join(centre, "id").where("to > id").select(F.col("to").alias("id"), F.col("low").alias("to")).distinct()
        least = outward.groupBy("id").agg(F.min("to").alias("low"))
        inward = outward.join(least, "id").where("to <> low").select(F.col("to").alias("id"), F.col("low").alias("to"))
        links = cut_lineage(inward.union(least.select("id", F.col("low").alias("to"))).distinct())
    return ends.select("id").distinct().join(links, "id", "left").select("id", F.coalesce("to", "id").alias("component"))


def _stars(links: DataFrame) -> bool:
    """True if every node has one smaller neighbour and that one has none."""
    roots = links.select(F.col("to").alias("id")).distinct()
    return links.groupBy("id").count().where("count > 1").isEmpty() and links.join(roots, "id", "left_semi").isEmpty()
