"""Connected components of an edge table by alternating star contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import shared_folder


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node it can reach.

    ``edges`` has two columns of one orderable type. Each round points all neighbours of a node at its
    smallest neighbour, larger ones first, then smaller ones; the edges end as one star per component
    after about log(size) rounds. Every round is checkpointed in the shared folder, minima are combined
    before they are shuffled, and only two totals per round reach the driver.
    """
    shared_folder(edges.sparkSession)
    a, b = edges.columns
    star = (edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
            .distinct().checkpoint())
    state = None
    while True:
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        large = (both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(low, "a").select(F.explode(F.array(F.struct("a", "low"), F.struct(F.col("b").alias("a"), "low"))).alias("e"))
                 .select("e.a", F.col("e.low").alias("b")).filter("a != b").distinct())
        star = small.checkpoint()
        now = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
