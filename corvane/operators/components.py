"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.skew import hub_join
from corvane.session import materialise, shared_root


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node that occurs in ``edges``; component = smallest node id.

    A large-star step links every larger neighbour of a node to the smallest node it knows; a small-star step does the same
    for the smaller neighbours and the node itself. Both keep the components, and the edges become stars around the
    smallest ids in about the logarithm of the longest path. Minima are summed map-side and hubs are joined by broadcast,
    so no task holds the neighbours of a hub. Null ends are ignored; an empty table gives an empty result. Each step is
    written to the shared folder.
    """
    shared_root(edges.sparkSession)
    all_ = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    all_ = materialise(all_.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = all_.select(F.col("u").alias("node")).union(all_.select("v")).distinct()
    links, before = all_.where("u <> v"), None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")).persist()  # a lost part is counted again
        large = materialise(hub_join(both, least, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least.unpersist()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).persist()
        small = hub_join(large, least, ["u"], "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        least.unpersist()
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(links.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
