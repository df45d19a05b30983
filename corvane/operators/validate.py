"""Checks of prediction submissions and manifests. Every check is a column or a join; only counts reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions.scalar import token_list

#: Labels are a short fixed list; more are an error.
MOST_LABELS = 10_000
STATUS = ("unknown_item", "unknown_label", "not_numeric", "not_finite", "out_of_range", "duplicate", "ok")


def require_columns(df: DataFrame, groups: dict[str, list[str]]) -> dict[str, str]:
    """The column that stands for each alias group; raises if a group has none."""
    found = {name: next((a for a in aliases if a in df.columns), None) for name, aliases in groups.items()}
    missing = [n for n, c in found.items() if c is None]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return found


def load_truth(df: DataFrame, labels: list[str], item: str = "item_id") -> DataFrame:
    """``(item_id, label_id, y)`` from any of three forms: rows of pairs (label_id, y), a list column of an item's labels (an array, JSON or
    text with separators), or a column for each label, named ``x``, ``label:x`` or ``y_x``. An item, or a pair, that occurs twice is
    an error, as is a table of no form."""
    if {"label_id", "y"} <= set(df.columns):
        out, key = df.select(F.col(item).alias("item_id"), "label_id", F.col("y").cast("int").alias("y")), ["item_id", "label_id"]
    elif "true_labels" in df.columns:
        listed = F.col("true_labels") if df.schema["true_labels"].dataType.typeName() == "array" else token_list("true_labels")
        flags = F.array(*(F.struct(F.lit(n).alias("label_id"), F.array_contains(listed, n).cast("int").alias("y")) for n in labels))
        out, key = df.select(F.col(item).alias("item_id"), F.explode(flags).alias("x")).select("item_id", "x.*"), ["item_id", "label_id"]
    else:
        named = {n: next((c for c in (n, f"label:{n}", f"y_{n}") if c in df.columns), None) for n in labels}
        if not all(named.values()):
            raise ValueError("the truth has none of the known forms")
        flags = F.array(*(F.struct(F.lit(n).alias("label_id"), F.col(f"`{c}`").cast("int").alias("y")) for n, c in named.items()))
        out, key = df.select(F.col(item).alias("item_id"), F.explode(flags).alias("x")).select("item_id", "x.*"), ["item_id", "label_id"]
    twice = out.groupBy(*key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"items given twice: {', '.join(str(r.item_id) for r in twice)}")
    return out


def check_rows(submission: DataFrame, items: DataFrame, labels: DataFrame, row_order: str = "row_order") -> DataFrame:
    """Adds ``status`` (the first failure, or ok) and ``value`` to rows (item_id, label_id, score as text)."""
    known = items.select("item_id").distinct().withColumn("_item", F.lit(True))
    names = labels.select("label_id").distinct().withColumn("_label", F.lit(True))
    rows = submission.join(known, "item_id", "left").join(F.broadcast(names), "label_id", "left")  # labels: a short fixed list
    rows = rows.withColumn("value", F.col("score").try_cast("double"))
    first = (
        F.when(F.col("_item").isNull(), "unknown_item")
        .when(F.col("_label").isNull(), "unknown_label")
        .when(F.col("value").isNull(), "not_numeric")
        .when(F.isnan("value") | F.abs("value").isin(float("inf")), "not_finite")
        .when(~F.col("value").between(0, 1), "out_of_range")
    )
    rows = rows.withColumn("_first", first)
    again = F.row_number().over(W.partitionBy("item_id", "label_id", F.col("_first").isNull()).orderBy(row_order)) > 1
    status = F.coalesce("_first", F.when(again, "duplicate"), F.lit("ok"))
    return rows.withColumn("status", status).drop("_item", "_label", "_first")


def complete_grid(checked: DataFrame, items: DataFrame, labels: DataFrame) -> DataFrame:
    """Every item with every label; missing pairs score 0. The label list is short and fixed."""
    names = [r.label_id for r in labels.select("label_id").distinct().limit(MOST_LABELS + 1).collect()]
    if len(names) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    grid = items.select("item_id").distinct().withColumn("label_id", F.explode(F.array(*map(F.lit, names))))
    ok = checked.where("status = 'ok'").select("item_id", "label_id", F.col("value").alias("score"))
    return grid.join(ok, ["item_id", "label_id"], "left").select("item_id", "label_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("score").isNull().alias("missing"))


def split_conflicts(manifest: DataFrame, key: str, split: str = "split", domain: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Keys with more than one split value, or with one outside the domain."""
    return manifest.groupBy(key).agg(F.count_distinct(split).alias("splits"), F.count_if(~F.col(split).isin(*domain)).alias("foreign")).where("splits > 1 or foreign > 0")


def policy_conflicts(used: DataFrame, policy: DataFrame) -> DataFrame:
    """Features of a track that its policy forbids or does not know."""
    j = used.join(policy, ["track", "feature"], "left")
    return j.select("track", "feature", F.when(F.col("rule").isNull(), "unrecognised").when(F.col("rule") == "forbidden", "forbidden").alias("problem")).where("problem is not null")
