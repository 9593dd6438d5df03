"""Connected components of links that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def least_neighbours(pairs: DataFrame) -> DataFrame:
    """u, m: the least of each node and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (a, b; both long, not null).

    Large and small stars by turns (Kiveris and others, 2014): all links of a node move to the smallest node around it, until
    every component is a star around its smallest node. Rounds grow with the logarithm of a component's size.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least_neighbours(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = least_neighbours(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = stored(small.where("u <> v").distinct(), "links")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(edges)
        edges = after
        if state == last:
            break
        last = state
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._sylva_path = edges._sylva_path
    return out
