"""Context features of items in ordered sequences, with priors that see training labels only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec

from corvane.functions.scalar import length_bin
from corvane.operators.neighbours import gaps


def train_priors(flag: Column, labelled: Column, seq: str, order: WindowSpec, radius: int, train: Column | None = None) -> tuple[Column, Column]:
    """(share among the other training items of the sequence, count within ``radius`` places, self excluded).

    Only training items count. ``labelled`` marks items with any label: a training item leaves the denominator only if it has one. No
    label of a held-out item can enter.
    """
    train = F.lit(True) if train is None else train
    all_ = W.partitionBy(seq)
    own = F.when(train, flag.cast("int")).otherwise(0)
    total, count = F.sum(train.cast("int")).over(all_), F.sum(own).over(all_)
    share = F.greatest(count - own, F.lit(0)) / F.greatest(total - (train & labelled).cast("int"), F.lit(1))
    return share, F.sum(own).over(order.rowsBetween(-radius, radius)) - own


def context_features(rows: DataFrame, order: WindowSpec, labels: dict[str, Column], radius: int = 3) -> DataFrame:
    """Rows (seq, row_order, start, end, strand, length, kind, segment, train) with the features of their surroundings.

    One window order serves all: the rows of a sequence are shuffled and sorted once. Unknown coordinates give gap and
    overlap 0; a sequence without segments counts as one; a lone item has position 0.
    """
    all_ = W.partitionBy("seq")
    n = F.count("*").over(all_)
    at = lambda c, k: F.lag(c, k).over(order) if k > 0 else F.lead(c, -k).over(order)
    low = F.min(F.when(F.col("start") > 0, F.col("start"))).over(all_)
    high = F.max(F.when(F.col("end") > 0, F.col("end"))).over(all_)
    span = F.greatest(F.lit(0), F.coalesce(high - low + 1, F.lit(0)))
    mean = F.avg("length").over(all_)
    same = lambda k: F.coalesce((F.col("strand") != "") & (at("strand", k) == F.col("strand")), F.lit(False)).cast("int")
    any_label = F.lit(False)
    for c in labels.values():
        any_label = any_label | c
    priors = []
    for name, flag in labels.items():
        share, local = train_priors(flag, any_label, "seq", order, radius, F.col("train"))
        priors += [share.alias(f"genome_{name}"), local.alias(f"local_{name}")]
    segments = F.size(F.array_remove(F.collect_set("segment").over(all_), "__UNSEGMENTED__"))
    out = gaps(rows, order).select(
        "seq", "row_order",
        F.coalesce(length_bin(at("length", 1)), F.lit("__START__")).alias("prev_length_bin"),
        F.coalesce(length_bin(at("length", -1)), F.lit("__END__")).alias("next_length_bin"),
        F.coalesce(at("kind", 1), F.lit("__START__")).alias("prev_kind"),
        F.coalesce(at("kind", -1), F.lit("__END__")).alias("next_kind"),
        F.log1p(n).alias("log_count"),
        F.coalesce(F.try_divide(F.row_number().over(order) - 1, n - 1), F.lit(0.0)).alias("position"),
        F.greatest(segments, F.lit(1)).alias("segments"),
        F.log1p(span).alias("log_span"),
        F.coalesce(F.try_divide(n * 1000.0, span), F.lit(0.0)).alias("density_per_kb"),
        mean.alias("mean_length"),
        F.coalesce(F.try_divide(F.stddev_pop("length").over(all_), mean), F.lit(0.0)).alias("length_cv"),
        at("row_order", 1).isNotNull().cast("int").alias("has_prev"),
        at("row_order", -1).isNotNull().cast("int").alias("has_next"),
        *(F.log1p(F.col(c)).alias(c) for c in ("gap_prev", "gap_next", "overlap_prev", "overlap_next")),
        same(1).alias("same_strand_prev"), same(-1).alias("same_strand_next"),
        *priors,
    )
    return out


def neighbour_slots(order: WindowSpec, radius: int) -> Column:
    """Array of structs at -radius..radius without 0: offset / radius, log length, log gap, log overlap, same strand, mask. An
    empty slot is all 0. Gaps are taken as coordinates stand, known or not."""
    slots = []
    for k in [*range(-radius, 0), *range(1, radius + 1)]:
        at = lambda c, k=k: F.lag(c, -k).over(order) if k < 0 else F.lead(c, k).over(order)
        left_end, right_start = (at("end"), F.col("start")) if k < 0 else (F.col("end"), at("start"))
        there = at("row_order").isNotNull()
        value = lambda c, there=there: F.when(there, c).otherwise(0.0)
        slots.append(F.struct(
            value(F.lit(k / radius)).alias("offset"),
            value(F.log1p(F.greatest(at("length"), F.lit(0)).cast("double"))).alias("log_length"),
            value(F.log1p(F.greatest(F.lit(0), right_start - left_end - 1).cast("double"))).alias("log_gap"),
            value(F.log1p(F.greatest(F.lit(0), left_end - right_start + 1).cast("double"))).alias("log_overlap"),
            value(F.coalesce((F.col("strand") != "") & (at("strand") == F.col("strand")), F.lit(False)).cast("double")).alias("same_strand"),
            there.cast("double").alias("mask"),
        ))
    return F.array(*slots)


def module_window(order: WindowSpec, radius: int, member: str, kind: str, unknown: Column, vote: Column, numbers: list[str]) -> Column:
    """The window of ``radius`` places around each item: members, signature, unknown share, kinds and their counts, vote share
    and the mean of ``numbers``."""
    w = order.rowsBetween(-radius, radius)
    kinds = F.collect_list(kind).over(w)
    names = F.array_sort(F.array_distinct(kinds))
    return F.struct(
        F.collect_list(member).over(w).alias("members"),
        F.concat_ws(">", kinds).alias("signature"),
        F.avg(unknown.cast("int")).over(w).alias("unknown"),
        F.concat_ws(",", F.transform(names, lambda n: F.concat(n, F.lit("="), F.size(F.filter(kinds, lambda x: x == n)).cast("string")))).alias("histogram"),
        F.avg(vote.cast("int")).over(w).alias("vote"),
        F.array(*(F.avg(c).over(w) for c in numbers)).alias("mean"),
    )
