"""Key chains and trees by pointer doubling: the number of joins grows with the logarithm of the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import materialise

#: A chain longer than 2 ** ROUNDS is taken for a cycle.
ROUNDS = 20


def chase(merges: DataFrame) -> DataFrame:
    """``(old, new, cyclic)``: the end of each chain of merges; ``cyclic`` marks keys whose chain never ends."""
    at = merges.select("old", "new")
    for _ in range(ROUNDS):
        step = at.select(F.col("old").alias("new"), F.col("new").alias("next"))
        more = materialise(at.join(step, "new", "left").select("old", F.coalesce("next", "new").alias("new"), F.col("next").isNotNull().alias("moved")), "chase")
        at = more.select("old", "new")
        if more.where("moved").isEmpty():
            break
    open_ = merges.select(F.col("old").alias("new")).distinct().withColumn("cyclic", F.lit(True))
    return at.join(open_, "new", "left").select("old", "new", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def root_paths(tree: DataFrame) -> DataFrame:
    """``(id, ids, names, depth)`` from the root to each node of (id, parent, name); a root is its own parent. Path pieces
    double in length each round. Nodes whose parent is missing start their own path. A cycle is an error: rounds end once
    paths are longer than the number of nodes."""
    at = tree.select("id", F.array("id").alias("ids"), F.array("name").alias("names"), F.when(F.col("id") != F.col("parent"), F.col("parent")).alias("up"))
    nodes = tree.count()
    for k in range(ROUNDS):
        if 2**k > 2 * nodes:
            raise ValueError("the tree has a cycle")
        above = at.select(F.col("id").alias("up"), F.col("ids").alias("ids2"), F.col("names").alias("names2"), F.col("up").alias("up2"))
        j = at.join(above, "up", "left")
        none = F.array().cast("array<string>")
        at = materialise(j.select("id", F.concat(F.coalesce("ids2", none), "ids").alias("ids"), F.concat(F.coalesce("names2", none), "names").alias("names"), F.col("up2").alias("up")), "paths")
        if at.where("up is not null").isEmpty():
            break
    return at.select("id", "ids", "names", (F.size("ids") - 1).alias("depth"))
