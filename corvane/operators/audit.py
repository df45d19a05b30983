"""Leakage and split audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_summary(df: DataFrame, keys: list[str], split: str) -> DataFrame:
    """``(key, train, test, shared)``: distinct values of each key column by side. One pass over the long form."""
    long = df.select(F.col(split).alias("s"), F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("v")) for k in keys))).alias("x")).select("s", "x.*")
    g = long.where("v is not null").groupBy("key", "v").agg(F.bool_or(F.col("s") == "train").alias("a"), F.bool_or(F.col("s") == "test").alias("b"))
    return g.groupBy("key").agg(F.count_if("a").alias("train"), F.count_if("b").alias("test"), F.count_if(F.col("a") & F.col("b")).alias("shared"))


def strict_zero(df: DataFrame, key: str, split: str) -> DataFrame:
    """Test rows with a known key that no training row has."""
    train = df.where((F.col(split) == "train") & F.col(key).isNotNull()).select(key)
    return df.where((F.col(split) == "test") & F.col(key).isNotNull()).join(train, key, "left_anti")


def align(a: DataFrame, b: DataFrame, item: str = "item_id", label: str = "label_id") -> DataFrame:
    """Inner join of two runs on item and label; raises if their label sets differ."""
    left, right = a.select(label).distinct(), b.select(label).distinct()
    if not left.exceptAll(right).union(right.exceptAll(left)).isEmpty():
        raise ValueError("the runs have different labels")
    return a.join(b, [item, label])
