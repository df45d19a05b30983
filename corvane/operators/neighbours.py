"""Ordered-neighbourhood features. All share one window, so a sequence is shuffled and sorted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec


def sequence_window(seq: str = "seq", start: str = "start", end: str = "end", row_order: str = "row_order") -> WindowSpec:
    """Known starts first, then start, end (unknown last) and input order."""
    return W.partitionBy(seq).orderBy(F.col(start) <= 0, start, F.when(F.col(end) > 0, F.col(end)).otherwise(10**12), row_order)


def neighbour(c: str, w: WindowSpec, step: int) -> Column:
    return F.lag(c, step).over(w) if step > 0 else F.lead(c, -step).over(w)


def gaps(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Gap and overlap to the previous and the next item; 0 where a coordinate is unknown."""
    known = lambda a, b: (F.col(a) > 0) & (F.col(b) > 0)
    out = df.withColumn("_pe", F.lag("end").over(w)).withColumn("_ns", F.lead("start").over(w))
    gap = lambda a, b: F.when(known(a, b), F.greatest(F.lit(0), F.col(b) - F.col(a) - 1)).otherwise(0)
    lap = lambda a, b: F.when(known(a, b), F.greatest(F.lit(0), F.col(a) - F.col(b) + 1)).otherwise(0)
    return out.withColumn("gap_prev", gap("_pe", "start")).withColumn("overlap_prev", lap("_pe", "start")).withColumn("gap_next", gap("end", "_ns")).withColumn("overlap_next", lap("end", "_ns")).drop("_pe", "_ns")


def local_count(flag: Column, w: WindowSpec, radius: int) -> Column:
    """Flags within ``radius`` places, without the item's own."""
    return F.sum(flag.cast("int")).over(w.rowsBetween(-radius, radius)) - flag.cast("int")


def leave_one_out(flag: Column, seq: str) -> Column:
    """Share of flagged items among the others of the sequence."""
    p = W.partitionBy(seq)
    return F.greatest(F.sum(flag.cast("int")).over(p) - flag.cast("int"), F.lit(0)) / F.greatest(F.count("*").over(p) - 1, F.lit(1))


def train_prior(flag: Column, train: Column, seq: str) -> Column:
    """Leave-one-out share over labelled training items only: no held-out label can enter."""
    p = W.partitionBy(seq)
    own = train.cast("int")
    return (F.sum(F.when(train, flag.cast("int")).otherwise(0)).over(p) - F.when(train, flag.cast("int")).otherwise(0)) / F.greatest(F.sum(own).over(p) - own, F.lit(1))


def slots(columns: list[str], w: WindowSpec, radius: int) -> Column:
    """Array of the neighbours at -radius..radius without 0; absent ones are null."""
    return F.array(*(neighbour_struct(columns, w, -k) for k in [*range(-radius, 0), *range(1, radius + 1)]))


def neighbour_struct(columns: list[str], w: WindowSpec, step: int) -> Column:
    s = F.struct(*columns)
    return F.lag(s, step).over(w) if step > 0 else F.lead(s, -step).over(w)


def within(df: DataFrame, centres: DataFrame, w: WindowSpec, seq: str, key: str, radius: int) -> DataFrame:
    """Items within ``radius`` ranks of each centre in its sequence. Ranks are cut in blocks of the radius, so the join
    has equal keys and each item meets three blocks."""
    ranked = df.withColumn("rank", F.row_number().over(w))
    block = F.floor(F.col("rank") / radius)
    at = ranked.join(centres.select(key), key, "left_semi").select(F.col(seq).alias("_seq"), F.col(key).alias("centre"), F.col("rank").alias("centre_rank"), F.explode(F.array(block - 1, block, block + 1)).alias("_block"))
    near = ranked.withColumn("_block", block)
    j = near.join(at, (F.col(seq) == F.col("_seq")) & (near["_block"] == at["_block"]) & (F.abs(F.col("rank") - F.col("centre_rank")) <= radius))
    return j.select("centre", (F.col("rank") - F.col("centre_rank")).alias("offset"), *df.columns)
