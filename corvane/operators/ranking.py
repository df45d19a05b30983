"""Ranks and running sums over groups of any size.

A window over a group sorts it in one task. Here rows are cut into ranges of the order first, ranked or summed inside each
range, and moved on by the totals of the ranges before; only these totals (one row for each group and range) meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.session import materialise


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds to each row the sums over the rows of its group from the first to itself in ``order``. Equal places have no order
    of their own, so ``order`` should end in a unique column."""
    cut = df.select("*", *(c.alias(f"_x_{n}") for n, c in sums.items())).repartitionByRange(*(F.col(k) for k in keys), *order)
    cut = materialise(cut.withColumn("_range", F.spark_partition_id()), "ranges")  # ranges stay what they are in both passes
    inside = W.partitionBy("_range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    part = cut.groupBy(*keys, "_range").agg(*(F.sum(f"_x_{n}").alias(f"_x_{n}") for n in sums))
    part = part.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_range"])), *(F.coalesce(F.sum(f"_x_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    same = F.lit(True)
    for i, k in enumerate([*keys, "_range"]):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    summed = cut.select("*", *(F.sum(f"_x_{n}").over(inside).alias(f"_i_{n}") for n in sums)).join(part, same)
    return summed.select(*df.columns, *((F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the place of each row in its group, from 1."""
    return running(df, keys, order, {name: F.lit(1)})


def following(df: DataFrame, keys: list[str], order: list[Column], column: str, name: str) -> DataFrame:
    """Adds ``column`` of the next row of the group in ``order``; null at its end."""
    placed = materialise(ranked(df, keys, order, "_place"), "places")
    after = placed.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), (F.col("_place") - 1).alias("_at"), F.col(column).alias(name))
    same = F.col("_place") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return placed.join(after, same, "left").select(*df.columns, name)
