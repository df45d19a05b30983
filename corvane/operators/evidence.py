"""Hit tables: filters, top hits, classes of evidence, priorities and recommendations of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def passing(hits: DataFrame, at_least: dict[str, float], at_most: dict[str, float]) -> DataFrame:
    """Rows that meet every threshold; a missing value passes."""
    ok = F.lit(True)
    for c, t in at_least.items():
        ok = ok & F.coalesce(F.col(c) >= t, F.lit(True))
    for c, t in at_most.items():
        ok = ok & F.coalesce(F.col(c) <= t, F.lit(True))
    return hits.where(ok)


def top_hit(hits: DataFrame, query: str = "query", order: str = "row_order") -> DataFrame:
    """Best hit of each query by bits, then identity, then the first seen; a partial maximum, no sort."""
    rest = [c for c in hits.columns if c != query]
    best = F.max_by(F.struct(*rest), F.struct("bits", F.coalesce("pident", F.lit(float("-inf"))), (-F.col(order)).alias("_o")))
    return hits.groupBy(query).agg(best.alias("h")).select(query, "h.*")


def sequence_status(identity: Column, labelled: Column, found: Column) -> Column:
    """Tier of the nearest sequence, with a suffix where its target has no label."""
    tier = F.when(identity.isNull(), "identity_missing").when(identity >= 90, "near_exact").when(identity >= 50, "high_identity").when(identity >= 30, "remote").otherwise("weak")
    return F.when(~found, "no_hit").otherwise(F.concat(tier, F.when(labelled, "").otherwise("_unlabelled")))


def structure_status(hits: Column, model: Column, prob: Column, score: Column, cover: Column, ambiguity: Column, strong: Column) -> Column:
    """Class of a structure hit from its probability, score and coverage, and from the confidence in the model searched."""
    sure, whole = prob >= 0.9, (score >= 0.4) & (cover >= 0.35)
    poor = F.when(sure, "hit_on_poor_model").otherwise("poor_model")
    good = F.when((ambiguity >= 0.5) | (strong > 3), "consistent_but_ambiguous").otherwise("consistent")
    return (
        F.when(hits.isNull() | (hits <= 0), "no_hit")
        .when(model < 50, poor)
        .when(sure & whole, good)
        .when(sure & (cover >= 0.25), "locally_consistent")
        .when((prob >= 0.5) | (score >= 0.3), "ambiguous_or_weak")
        .otherwise("inconclusive")
    )


#: Points of a structure class in the priority of a case.
STRUCTURE_POINTS = {"consistent": 1.5, "consistent_but_ambiguous": 1.1, "locally_consistent": 0.9, "ambiguous_or_weak": 0.4, "hit_on_poor_model": 0.3}


def case_priority(gain: Column, p: Column, identity: Column, structure: Column, in_module: Column, unknown: Column, copied: Column) -> Column:
    """Priority of a case study: the gain, a confident score, a distant nearest sequence, structure, module, less for copies."""
    points = F.lit(0.0)
    for name, value in STRUCTURE_POINTS.items():
        points = F.when(structure == name, value).otherwise(points)
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    distant = F.when(identity.isNull() | (identity < 30), 1.0).when(identity < 50, 0.5).otherwise(0.0)
    return 3.0 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), gain)) + flag(p >= 0.8, 0.6) + distant + points + flag(in_module, 0.7) + flag(unknown, 0.4) - flag(copied, 0.8)


def recommended(cases: DataFrame, key: str, label: str, priority: str, places: int = 6) -> DataFrame:
    """Keys of the cases for display: the best of each label first, then the best of the rest. Ties go to the least key."""
    by = F.struct(priority, -F.col(key))
    first = cases.where(F.col(label) != "").groupBy(label).agg(F.max_by(key, by).alias(key)).select(key, F.lit(1).alias("_first"))
    order = [F.coalesce("_first", F.lit(0)).desc(), F.desc(priority), F.col(key)]
    return cases.select(key, priority).join(first, key, "left").orderBy(*order).limit(places).select(key)
