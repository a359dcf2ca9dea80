"""Connected components of a link table, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def _are_stars(edges: DataFrame) -> bool:
    """Whether every id above some other (u > v) has one link and is below none."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id that ``links`` (a, b: long) has: the least id that links reach.

    Each round hooks all neighbours of an id to its least neighbour: first those above the id
    (large star), then those below (small star). Least neighbours come from a pre-aggregated
    minimum and go back by a join, whose second key makes Spark deal both sides anew: so it can split a
    hub's links, which would otherwise stay with the aggregate in one task. Rounds end when the
    links are stars; a path of n ids takes about log n of them. Each round is stored.
    """
    again = F.xxhash64("u").alias("again")
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = store(edges, "links")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").select("u", "v", again).join(least.select("u", "m", again), ["u", "again"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.select("u", "v", again).join(least.select("u", "m", again), ["u", "again"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = store(small.unionByName(least.toDF("u", "v")).distinct(), "stars")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
