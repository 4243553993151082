"""Connected components of a link table by alternating large-star and small-star steps.

Defined results: links to itself and links with a null end are no links; repeated links count
once; nodes without a link are not returned; no links give no rows; other columns are ignored.
The number of steps grows with the logarithm of the longest chain and has no limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import release_all_but_last, scope, spool


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links(a, b).

    Each step is a min per node and a join, so a hub's links are never gathered in one row;
    the steps are written to the shared folder, and a step's table goes when the next is there.
    It ends when a step changes nothing, which the sums of two hashes of all links tell.
    """
    with scope(links.sparkSession) as made:
        edges, before = spool(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc"), None
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            near = large.join(low, "u")
            small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
            edges = spool(small, "cc")
            release_all_but_last(links.sparkSession, made)
            now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())
