"""Deterministic sampling: all chance is MD5 of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.operators.ranking import ranked
from corvane.session import materialise


def round_robin(df: DataFrame, label: str, strata: list[str], order: list[Column], most: int) -> DataFrame:
    """One row of each stratum in turn until ``most`` for a label. Only the first ``most`` of a stratum can be taken, so the
    second ranking sees few rows."""
    rn = F.row_number().over(W.partitionBy(label, *strata).orderBy(*order))
    few = df.withColumn("rn", rn).where(F.col("rn") <= most)
    return few.withColumn("k", F.row_number().over(W.partitionBy(label).orderBy("rn", *strata))).where(F.col("k") <= most)


def shuffle_within(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """A permutation inside each group: adds ``donor_<column>`` of another row for every other column. A group whose
    permutation changes nothing is turned by one place; a lone row is its own donor. Places are ranks over ranges, so no task holds a
    group."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))
    rest = [c for c in df.columns if c not in (group, key)]
    both = ranked(ranked(df, [group], [F.col(key)], "_a"), [group], [digest, F.col(key)], "_b")
    size = both.groupBy(group).agg(F.count("*").alias("_n"), F.bool_or(F.col("_a") != F.col("_b")).alias("_moved"))
    own = both.join(size, group).withColumn("_at", F.when(F.col("_moved"), F.col("_a")).otherwise(F.col("_a") % F.col("_n") + 1))
    donor = both.select(group, F.col("_b").alias("_at"), *(F.col(c).alias(f"donor_{c}") for c in rest))
    return own.join(donor, [group, "_at"]).drop("_a", "_b", "_at", "_n", "_moved")


def corrupt_fraction(df: DataFrame, key: str, group: str, columns: list[str], fraction: float) -> DataFrame:
    """The rows with ``donor``: the ``round(fraction * n)`` rows of lowest hash take ``columns`` of another row of their group, or of any
    row where they are alone in it; donor is null for the others. Donors are found by rank, no group meets in one task."""
    hash_ = lambda p: F.md5(F.concat(F.lit(f"{p}|"), F.col(key).cast("string")).cast("binary"))
    n = df.agg(F.count("*").alias("n"), F.bround(F.count("*") * fraction).cast("bigint").alias("want")).first()
    placed = ranked(ranked(df, [group], [F.col(key)], "_a"), [], [F.col(key)], "_g")
    placed = materialise(ranked(placed, [], [hash_("c"), F.col(key)], "_h"), "placed")
    size = placed.groupBy(group).agg(F.count("*").alias("_n"))
    step = F.conv(F.substring(hash_("d"), 1, 8), 16, 10).cast("bigint")
    turn = lambda place, size: (F.col(place) + step % F.greatest(size - 1, F.lit(1))) % size + 1  # noqa: E731  never its own place
    chosen = placed.where(F.col("_h") <= n["want"]).join(size, group)
    alone = F.col("_n") == 1
    chosen = chosen.select(key, group, F.when(~alone, turn("_a", F.col("_n"))).alias("_near"), F.when(alone & F.lit(n["n"] > 1), turn("_g", F.lit(n["n"]))).alias("_far"))
    values = [F.struct(F.col(key).alias("donor"), *columns).alias("_v")]
    near = chosen.join(placed.select(group, F.col("_a").alias("_near"), *values), [group, "_near"]).select(key, "_v")
    far = chosen.join(placed.select(F.col("_g").alias("_far"), *values), "_far").select(key, "_v")
    out = df.join(near.union(far), key, "left")
    given = [F.when(F.col("_v").isNotNull(), F.col(f"_v.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns]
    return out.select(*given, F.col("_v.donor").alias("donor"))
