"""Conforming tables: projections by mode, rule tables, tiered joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A rule table larger than this is not a rule table.
MOST_RULES = 10_000


def project_mode(df: DataFrame, modes: dict[str, list[str]], mode: str, columns: list[str]) -> DataFrame:
    """The wanted columns; raises before planning if the mode does not allow one of them."""
    wrong = [c for c in columns if c not in modes[mode]]
    if wrong:
        raise ValueError(f"mode {mode} does not allow {', '.join(wrong)}")
    return df.select(*columns)


def apply_rules(df: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """One row for each item and rule whose pattern is in the text and whose exclusion is not, without case. The rules are
    a short checked list, applied as expressions in one pass."""
    rows = rules.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    hit = [F.when(F.col(text).rlike(f"(?i)(?:{r.pattern})") & (~F.col(text).rlike(f"(?i)(?:{r.exclude})") if r.exclude else F.lit(True)), r.label) for r in rows]
    return df.withColumn("label", F.explode(F.array_compact(F.array(*hit))))


def tiered_join(df: DataFrame, tiers: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """Adds ``value`` from the first tier that has the row's key, and ``strategy``, the tier's name."""
    out, found, name = df, [], F.lit("none")
    for k, (_, right, keys) in enumerate(tiers):
        out = out.join(right.withColumnRenamed(value, f"_v{k}"), keys, "left")
        found.append(F.col(f"_v{k}"))
    for k in reversed(range(len(tiers))):
        name = F.when(found[k].isNotNull(), tiers[k][0]).otherwise(name)
    return out.withColumn(value, F.coalesce(*found)).withColumn("strategy", name).drop(*(f"_v{k}" for k in range(len(tiers))))
